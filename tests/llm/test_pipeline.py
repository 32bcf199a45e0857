"""Every stage of the pipeline on all that the one before kept, against brute force."""

from __future__ import annotations

import collections

import corpus_pipeline
import pytest

from helixlake.llm import langid
from helixlake.llm.mixing import MOST
from test_operators import SCHEMA, cut_pieces, hard_documents, near_groups, prose, same, without_repeats, words


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("pipeline")
    rows = hard_documents()
    rows += [(500 + i, prose(40) + "\n" + prose(12), "en", f"s{i % 4}", 1, "r", "u", "h", "z", "q", "k") for i in range(60)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_stages(spark, folder):
    docs, columns = spark.read.parquet(f"{folder}/documents.parquet"), None
    counts = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        columns = docs.columns
        before = docs.collect()
        out = stage(spark, docs, folder)
        after = out.collect()
        counts.append(len(after))
        if k < 4:
            assert out.columns == columns, name
        if name == "language_id":
            known = {(r["doc_id"], r["text"]) for r in before}
            model = langid.train(docs)
            scored = collections.defaultdict(list)
            for r in langid.identify(docs, model).collect():
                scored[r["doc_id"]].append(r["lang_pred"] != "und" and r["score"] >= model.level)
            assert all((r["doc_id"], r["text"]) in known for r in after)
            same([r["doc_id"] for r in after], [i for i, keep in scored.items() for x in keep if x])
            assert not {0, 1, 2, 13} & {r["doc_id"] for r in after} and len(after) > 0.9 * (len(before) - 4)
        elif name == "line_dedup":
            want = without_repeats([(r["doc_id"], r["text"]) for r in before])
            same([(r["doc_id"], r["text"]) for r in after], [(r["doc_id"], want[k]) for k, r in enumerate(before) if want[k] == r["text"] or words(want[k])])
            assert all(r["n_chars"] == len(r["text"]) for r in after)
        elif name == "minhash_near_dedup":
            heads = {}
            for g, r in zip(near_groups([r["text"] for r in before]), before):
                key = (r["doc_id"] is None, r["doc_id"] or 0)
                if g not in heads or key < heads[g][0]:
                    heads[g] = (key, r["doc_id"], r["text"])
            same([(r["doc_id"], r["text"]) for r in after], [x[1:] for x in heads.values()])
        elif name == "source_mixing":
            size, taken = collections.Counter(), collections.Counter()
            for r in before:
                size[r["source"]] += len(words(r["text"]))
            for r in after:
                taken[r["source"]] += len(words(r["text"]))
            times = collections.Counter((r["doc_id"], r["text"]) for r in after)
            assert set(times) <= {(r["doc_id"], r["text"]) for r in before} and max(times.values()) <= MOST
            # Weights 5, 2, 1, 5 ... by source, null last; what a source can't fill goes to the others.
            weight = dict(zip(sorted(size, key=lambda s: (s is None, s or "")), (5, 2, 1, 5, 2)))
            target, free, left = {}, set(size), sum(size.values())
            while True:
                share = left / sum(weight[s] for s in free)
                full = {s for s in free if share * weight[s] > MOST * size[s]}
                if not full:
                    break
                target |= {s: MOST * size[s] for s in full}
                left, free = left - sum(target[s] for s in full), free - full
            target |= {s: share * weight[s] for s in free}
            most = max(len(words(r["text"])) for r in before)
            assert all(abs(taken[s] - target[s]) <= most for s in size)
        else:
            same([(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in after], cut_pieces([(r["doc_id"], r["text"]) for r in before]))
        docs = spark.createDataFrame(after, out.schema) if after else out
    assert corpus_pipeline.run(spark, folder).count() == counts[-1]


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert all(stage(spark, docs, str(tmp_path)).count() == 0 for _, stage in corpus_pipeline.STAGES)
