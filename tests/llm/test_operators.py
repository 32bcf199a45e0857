"""Each operator on one small table of hard cases, against brute force, and on the empty table."""

from __future__ import annotations

import collections
import hashlib
import itertools
import math
import os
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from helixlake.llm import ctw, dartminhash, fingerprint, kernels, langid, line_dedup, mixing, packing, pii, suffix_dedup, vector_dedup

RNG = random.Random(4)
#: Names that the operators use inside, as columns of the input.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, uid string, h1 string, size string, hash string, key string"
WORDS = [f"{a}{b}{c}" for a in ("ta", "lo", "mi", "ser") for b in ("ne", "ka", "ru") for c in ("", "s", "th")]


def prose(n: int) -> str:
    return " ".join(RNG.choice(WORDS) for _ in range(n))


def hard_documents() -> list[tuple]:
    passage, line = prose(60), prose(12)
    texts = [None, "", " \n\t ", "a", "one line", prose(80), prose(300) + "\n" + line, line + "\n" + prose(30), passage + " " + prose(20), prose(15) + " " + passage,
             "x" * 50_000, prose(4000), "été ñandú 日本語 " + prose(20), "1234 5678 !!!", "same\nsame\nsame\n" + line]
    near = prose(200).split()
    texts += [" ".join(near), " ".join(near[:100] + ["other"] + near[101:])]
    texts += ["copied text " + prose(40)] * 4 + [f"it's {prose(60)} don't 'quote' 12 a  b\r\n" for _ in range(5)] + [prose(RNG.randint(5, 120)) for _ in range(20)]
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 3}" if i % 7 else None, 1, "r", "u", "h", "z", "q", "k") for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, "no id " + prose(10), None, None, None, None, None, None, None, None, None)]
    return rows


@pytest.fixture(scope="module")
def table():
    return hard_documents()


@pytest.fixture(scope="module")
def docs(spark, table):
    return spark.createDataFrame(table, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def same(a, b):
    assert collections.Counter(a) == collections.Counter(b)


def without_repeats(table):
    """Texts by row after line dedup, by comparing all runs of lines."""
    order = sorted(range(len(table)), key=lambda k: (table[k][0] is not None, table[k][0] or 0))
    seen, want = set(), {}
    for k in order:
        lines = (table[k][1] or "").split("\n") if table[k][1] else []
        count = [len(words(x)) for x in lines]
        spans = set()
        for a in range(len(lines)):
            for b in range(a, len(lines)):
                if sum(count[a : b + 1]) >= line_dedup.MIN_WORDS:
                    spans.add((a, b))
                    break
        for b in range(len(lines)):
            for a in range(b, -1, -1):
                if sum(count[a : b + 1]) >= line_dedup.MIN_WORDS:
                    spans.add((a, b))
                    break
        gone = set()
        for a, b in sorted(spans):
            body = tuple(lines[a : b + 1])
            if body in seen:
                gone |= set(range(a, b + 1))
            seen.add(body)
        want[k] = "\n".join(x for i, x in enumerate(lines) if i not in gone) if gone else table[k][1]
    return want


def near_groups(texts):
    """A group for each text, by comparing all pairs."""
    sets = [collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if (w := words(t)) else None for t in texts]
    group = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if group[a] != group[b] and sets[a] and sets[b] and sum((sets[a] & sets[b]).values()) >= 0.8 * sum((sets[a] | sets[b]).values()):
                group = [group[b] if g == group[a] else g for g in group]
    return group


def cut_pieces(table):
    """(doc_id, piece, start, length, crc) of rows (doc_id, text), one text at a time."""
    from tokenizers import Tokenizer

    tok, want = Tokenizer.from_file(packing.tokenizer_path()), []
    for doc_id, text in table:
        ids = tok.encode(text or "", add_special_tokens=False).ids + [2]
        cut = [0] + list(range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)) if len(ids) > 1024 else [0, len(ids)]
        for piece, (a, b) in enumerate(zip(cut[:-1], cut[1:])):
            want.append((doc_id, piece, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    return want


def test_line_dedup(docs, table, empty, spark):
    got = line_dedup.dedup(docs).collect()
    assert len(got) == len(table)
    want = without_repeats([(r[0], r[1]) for r in table])
    same([(r["row"]["doc_id"], r["row"]["text"]) for r in got], [(table[k][0], want[k]) for k in want])
    assert all(r["row"]["uid"] in ("u", None) for r in got)
    body = "ten words that stand in every one of these lines"
    long = spark.createDataFrame([(1, "\n".join([body] * 30_000 + ["end"]))], "doc_id long, text string")
    got = line_dedup.dedup(long).first()
    assert (got["row"]["text"], got["n_lines"], got["n_deleted"]) == (body + "\nend", 30_001, 29_999)
    left = line_dedup.drop_repeats(docs)
    assert left.columns == docs.columns and left.where("doc_id = 10").count() == 1
    assert line_dedup.dedup(empty).count() == 0


def test_packing(docs, table, empty):
    rows, want = packing.pack(docs).collect(), cut_pieces([(r[0], r[1]) for r in table])
    same([(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows], want)
    places = collections.defaultdict(list)
    for r in rows:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(places) <= sum(w[3] for w in want) / 1024 * 1.1 + 2
    assert packing.pack(empty).count() == 0


def test_best_fit_plan_fills_every_slot_once():
    for _ in range(20):
        counts = {n: RNG.randint(1, 50) for n in RNG.sample(range(1, 1025), 60)}
        fill, ranks = collections.Counter(), collections.Counter()
        for length, first, many, at, per, place in packing.plan_slots(counts):
            assert first == ranks[length]
            ranks[length] += many
            for j in range(many):
                assert fill[at + j // per] == place + j % per * length
                fill[at + j // per] += length
        assert ranks == counts and max(fill.values()) <= 1024


def test_personal_data(docs, spark, empty):
    text = "mail a.b@c.de, x@y 10.0.0.256 1.2.3.4 card 4111 1111 1111 1111 no 4111111111111112 call +1 (415) 555-2671 or é@x.yz"
    rows = spark.createDataFrame([(1, text), (2, None), (3, ""), (1, text)], "doc_id long, text string")
    got = pii.find(docs.select("doc_id", "text").union(rows)).where("n_email + n_ip + n_card + n_phone > 0").collect()
    spans = [(0, 5, 13), (1, 30, 37), (2, 43, 62), (3, 88, 105)]
    mail = text.index("a.b@c.de")
    assert pii.base_spans(text)[0][:2] == (mail, mail + 8)
    assert {(r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) for r in got} == {(1, 1, 1, 1)} and len(got) == 2, spans
    assert got[0]["base_sha256"] == hashlib.sha256(pii.joined(pii.base_spans(text)).encode()).hexdigest()
    assert set(pii.joined(pii.base_spans(text)).split(",")) <= set(got[0]["spans"].split(","))
    assert pii.find(empty).count() == 0


CONTRACT = ((0, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), (1, r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
            (2, r"[0-9]([\x20-]?[0-9])+"), (3, r"\+[0-9][\x20().0-9-]+[0-9]"))


def test_base_spans_are_those_of_the_patterns():
    def fine(kind, t):
        digits = [int(c) for c in t if c in "0123456789"]
        if kind == 1:
            return all(int(x) <= 255 for x in t.split("."))
        if kind == 2:
            check = sum(sum(divmod(2 * d, 10)) if i % 2 else d for i, d in enumerate(digits[::-1]))
            return 14 <= len(digits) <= 19 and check % 10 == 0
        return kind == 0 or 10 <= len(digits) <= 15

    rng, found = random.Random(3), collections.Counter()
    pieces = ["a.b", "@", "c.de", "é", " ", "-", "+", "(", ")", ".", "1", "255", "0256", "10.0.0.1", "4111 1111 1111 1111", "4111111111111111", "+1 415 555 26712", "x@y.z", "@@"]
    for _ in range(4000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 14)))
        want = sorted(((m.start(), m.end(), kind) for kind, p in CONTRACT for m in re.finditer(p, text) if fine(kind, m.group())), key=lambda s: (s[0], s[2]))
        assert pii.base_spans(text) == want, text
        found.update(k for _, _, k in want)
    assert all(found[k] > 100 for k in range(4))


def test_no_text_with_an_address_is_passed_over():
    rng = random.Random(6)
    pieces = ["at", "AT", " at ", "[at]", "(at)", " ( at ) ", "dot", " dot ", "[dot]", ".", "x", "é", "\u00a0", " ", "\n", "-", "a1"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 12))) for _ in range(4000)]
    found = [k for k, t in enumerate(texts) if pii._ADDRESS.search(t)]
    (part,) = kernels.chunks(pa.array(texts))
    assert len(found) > 100 and set(found) <= pii._spelled(part)
    # A window is laid at the sign of every such address.
    assert all(pii.starts(texts[k]) for k in found)


def test_decoding_is_exact():
    r = np.random.RandomState(1)
    T, first = r.normal(size=(4, 4)), r.normal(size=4)
    e = r.normal(size=(3, 5, 4))
    size = np.array([5, 3, 1])
    got = pii.viterbi(e, T, first, size)
    for row, n, tags in zip(e, size, got):
        paths = list(itertools.product(range(4), repeat=int(n)))
        value = np.array([first[p[0]] + sum(row[t, p[t]] for t in range(n)) + sum(T[a, b] for a, b in zip(p, p[1:])) for p in paths])
        assert tuple(tags[:n]) == paths[value.argmax()]
        share = np.exp(value - value.max()) / np.exp(value - value.max()).sum()
        node = pii.marginals(row[None, :n], T, first)[0][0]
        assert np.allclose(node, [[share[[p[t] == k for p in paths]].sum() for k in range(4)] for t in range(n)])


def test_windows_are_reconciled_by_weighted_means():
    tagger = pii.Tagger()
    text = "x" * 10 + "12" * 70 + "y" * 200 + " jane at mail dot example dot org " + "z" * 90
    parts = pii.stretches(tagger, [text, "", "7"])
    assert [k for k, _, _ in parts] == [0, 0, 2]
    ids, place = pii.symbols(text), pii.starts(text)
    for k, a, e in parts[:2]:
        total, weight = np.zeros((len(e), pii.TAGS)), np.zeros(len(e))
        for s in place:
            if a <= s < a + len(e):
                own = tagger.emissions(np.pad(ids[s : s + pii.WINDOW], (0, max(0, s + pii.WINDOW - len(ids))), constant_values=1)[None])[0]
                for t in range(min(pii.WINDOW, a + len(e) - s)):
                    w = min(t + 1, pii.WINDOW - t)
                    total[s - a + t] += w * own[t]
                    weight[s - a + t] += w
        assert np.allclose(e, total / weight[:, None])


def test_tagger_finds_other_spellings():
    rng, texts = random.Random(7), []
    name = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8)))
    for _ in range(500):
        texts.append(f"{prose(8)} {name()}.{name()}@{name()}.org {prose(6)} +{rng.randint(1, 9)} {rng.randint(100, 999)} {rng.randint(100, 999)} {rng.randint(1000, 9999)} {prose(8)} {rng.randint(1, 99)}")
    tagger = pii.train(texts)
    hits, held = 0, 60
    for _ in range(held):
        body = f"{prose(9)} {name()} [at] {name()} [dot] org {prose(9)}"
        spans = pii.added_spans(tagger, [body], [pii.base_spans(body)])[0]
        hits += any(k == 0 and "[at]" in body[a:b] for a, b, k in spans)
    assert hits >= 0.7 * held
    clean = [prose(60) for _ in range(50)]
    assert not any(pii.added_spans(tagger, clean, [[]] * 50))
    began = time.time()
    pii.added_spans(tagger, ["1234567890 " * 100_000], [[]])
    assert time.time() - began < 120


def test_personal_data_gradient():
    t, r = pii.Tagger(), np.random.RandomState(0)
    ids, tags = r.randint(0, pii.SYMBOLS, (2, 7)), r.randint(0, pii.TAGS, (2, 7))
    _, grad = t.loss(ids, tags)
    for k, g in grad.items():
        at = (ids[0, 1], 2) if k == "E" else tuple(r.randint(0, s) for s in g.shape)
        old = t.p[k][at]
        t.p[k][at] = old + 1e-5
        up = t.loss(ids, tags)[0]
        t.p[k][at] = old - 1e-5
        down = t.loss(ids, tags)[0]
        t.p[k][at] = old
        assert abs((up - down) / 2e-5 - g[at]) < 1e-5


def test_vectors(spark):
    r = np.random.RandomState(2)
    base = r.normal(size=(60, 16))
    rows = [(i, [float(x) for x in base[i]], i % 3) for i in range(60)]
    rows += [(100 + i, [float(x) for x in base[i % 10] * 2 + r.normal(size=16) * 0.1], i % 10 % 3) for i in range(40)]
    rows += [(200, None, 1), (201, [0.0] * 16, 1), (202, [float("nan")] + [1.0] * 15, 1), (203, [None] + [1.0] * 15, 1), (204, rows[0][1], None), (205, rows[0][1], 0), (206, rows[0][1], 0)]
    got = {x["vec_id"]: x for x in vector_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)).collect()}
    fine = {i: np.array(v) / np.linalg.norm(v) for i, v, lab in rows if v and None not in v and np.isfinite(v).all() and any(v) and lab is not None}
    label = {i: lab for i, _, lab in rows}
    links = {i: {j for j in fine if j != i and label[i] == label[j] and fine[i] @ fine[j] >= 0.93} for i in fine}
    assert len(got) == len(rows)
    for i, _, _ in rows:
        seen, todo = {i}, [i]
        while todo:
            for j in links.get(todo.pop(), ()):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (len(links.get(i, ())), min(seen), i == min(seen))
    assert vector_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<double>, label int")).count() == 0


def test_vectors_in_many_lists_and_blocks(spark, monkeypatch):
    """Recall against brute force where lists are small, links are dense, widths differ and vec_ids repeat."""
    monkeypatch.setattr(vector_dedup, "LIST_ROWS", 12)
    monkeypatch.setattr(vector_dedup, "BLOCK", 20)
    r = np.random.RandomState(4)
    centres = r.normal(size=(25, 24))
    rows = [(i, list(map(float, centres[i % 25] + r.normal(size=24) * r.choice([0.1, 0.28])))) for i in range(500)]
    rows += [(1000 + i, list(map(float, np.ones(16) + r.normal(size=16) * 0.01))) for i in range(60)] + [(2000, [1.0] * 400), (2001, [1.0]), (2002, [-3.0]), (2003, [7.0])]
    rows += [rows[3], rows[3], rows[7]]
    table = spark.createDataFrame([(i, v, "x", "clash", 5) for i, v in rows], "vec_id long, embedding array<double>, label string, id string, list int").repartition(4)
    got = collections.defaultdict(set)
    for x in vector_dedup.near_duplicates(table).collect():
        got[x["vec_id"]].add((x["n_links"], x["component_id"]))
    units = [np.array(v) / np.linalg.norm(v) for _, v in rows]
    near = [[a != b and len(units[a]) == len(units[b]) and units[a] @ units[b] >= 0.93 for b in range(len(rows))] for a in range(len(rows))]
    want = {rows[a][0]: sum(near[a]) for a in range(len(rows))}
    assert all(len(x) == 1 for x in got.values()) and set(got) == set(want)
    links = {i: next(iter(x))[0] for i, x in got.items()}
    assert all(links[i] <= want[i] for i in want)
    assert sum(links.values()) >= 0.97 * sum(want.values()) > 5000
    assert all(links[1000 + i] == 59 and next(iter(got[1000 + i]))[1] == 1000 for i in range(60)) and (links[2001], links[2002], links[2003]) == (1, 0, 1)


def test_language(docs, table, empty, spark):
    de = " ".join(RNG.choice(["über", "nicht", "und", "schön", "die"]) for _ in range(9))
    rows = [(1000 + i, de if i % 2 else prose(30), "de" if i % 2 else "en") for i in range(80)]
    both = spark.createDataFrame(rows, "doc_id long, text string, lang string").union(docs.select("doc_id", "text", "lang"))
    model = langid.train(both)
    got = langid.identify(both, model).collect()
    assert len(got) == len(rows) + len(table)
    by = {r["doc_id"]: r for r in got}
    assert all(by[i]["lang_pred"] == lang for i, _, lang in rows)
    assert by[0]["lang_pred"] == by[1]["lang_pred"] == by[13]["lang_pred"] == "und" and by[0]["score"] == 0
    assert all(0 <= r["score"] <= 1 and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got if r["doc_id"] is not None)
    kept = langid.keep_identified(docs, model)
    assert kept.columns == docs.columns and not {0, 1, 2, 13} & {r["doc_id"] for r in kept.collect()}
    assert langid.identify(empty, langid.train(empty)).count() == 0


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.01"), reason="needs the driver's tables")
def test_language_of_held_out_documents(spark):
    """Accuracy on documents that were not learnt from, and a rejection that costs few right answers."""
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r["doc_id"]: r["lang"] for r in table.select("doc_id", "lang").collect()}
    got = [r for r in langid.identify(table, langid.train(table)).collect() if r["held_out"] and truth[r["doc_id"]] and r["lang_pred"] != "und"]
    right = [r["lang_pred"] == truth[r["doc_id"]] for r in got]
    assert len(got) > 150 and np.mean(right) > 0.97
    assert np.mean([r["rejected"] for r, ok in zip(got, right) if ok]) < 0.02
    model = langid.fit(["aa bb cc " * 9] * 40 + ["xx yy zz " * 9] * 40, ["l"] * 40 + ["m"] * 40)
    names, scores = model.predict(pa.array(["aa bb cc", "xx yy zz", "aa bb xx yy", "1", None]))
    assert names[:2] == ["l", "m"] and list(model.accepted(names, scores)[[0, 1, 3, 4]]) == [True, True, False, False]


def test_mixing(docs, table, empty):
    got = mixing.mix_report(docs).collect()
    assert len(got) == len(table)
    size, taken, target = collections.Counter(), collections.Counter(), {}
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"]
        size[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert sum(size.values()) == sum(len(words(r[1])) for r in table)
    assert abs(sum(target.values()) - sum(size.values())) < 1e-6 and all(target[s] <= 3 * size[s] + 1e-9 for s in size)
    most = max(r["size"] for r in got)
    assert all(abs(taken[s] - target[s]) <= most for s in size)
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns
    assert sum(len(words(r["text"])) for r in mixed.collect()) == sum(taken.values())
    assert mixing.mix_report(empty).count() == 0


def test_passages(docs, table, empty):
    got = suffix_dedup.repeat_report(docs).collect()
    text = {r[0]: words(r[1]) for r in table}
    pairs = {(r["doc_id"], r["source_doc_id"]) for r in got}
    assert {frozenset((8, 9))} <= {frozenset(p) for p in pairs}
    for r in got:
        a, b, n = r["start_word"], r["source_start_word"], r["n_words"]
        assert n >= 50 and text[r["doc_id"]][a : a + n] == text[r["source_doc_id"]][b : b + n]
    left = suffix_dedup.remove(docs)
    assert left.columns == docs.columns and left.count() == len(table)
    assert suffix_dedup.repeat_report(empty).count() == 0


def test_short_partner_hides_no_longer_one(spark):
    rng = random.Random(11)
    own = lambda n: [f"w{rng.getrandbits(40)}" for _ in range(n)]
    texts = []
    for shared, whole in ((26, 50), (35, 55), (40, 60), (45, 60), (49, 51), (45, 75), (48, 97)):
        passage = own(whole)
        at = rng.randint(0, whole - shared)
        texts += [own(30) + passage[at : at + shared] + own(30), own(20) + passage + own(40), own(rng.randint(0, 40)) + passage + own(rng.randint(0, 40))]
    table = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    got = collections.defaultdict(set)
    for r in suffix_dedup.repeat_report(table).collect():
        got[r["doc_id"]] |= set(range(r["start_word"], r["start_word"] + r["n_words"]))
    seen, want = set(), collections.defaultdict(set)
    for i, t in enumerate(texts):
        for k in range(len(t) - 49):
            if (window := tuple(t[k : k + 50])) in seen:
                want[i] |= set(range(k, k + 50))
            seen.add(window)
    assert len(want) == 7 and got == want


def test_long_repeat_is_reported_whole(spark):
    rng = random.Random(12)
    own = lambda n: [f"w{rng.getrandbits(40)}" for _ in range(n)]
    passage = own(1000)
    texts = [own(30) + passage[:600] + own(30), own(20) + passage + own(20), own(10) + passage + own(10)]
    table = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    got = [tuple(r[c] for c in ("doc_id", "start_word", "n_words", "source_doc_id", "source_start_word")) for r in suffix_dedup.repeat_report(table).collect()]
    assert (2, 10, 1000, 1, 20) in got


def test_long_repeat_takes_few_rounds(spark, monkeypatch):
    """A repeat of 6,000 words, known at first by 50 of them, is whole after four rounds, and small values travel for it."""
    rng = random.Random(13)
    own = lambda n: [f"w{rng.getrandbits(40)}" for _ in range(n)]
    passage = own(6000)
    texts = [own(9) + passage + own(9), own(20) + passage + own(30)]
    table = spark.createDataFrame([(i, i, " ".join(t)) for i, t in enumerate(texts)], "uid long, doc_id long, text string").coalesce(1)
    suffix_dedup.prepare(spark)
    index = suffix_dedup._index(table)
    match = spark.createDataFrame([(1, 0, 11, 3000, 3050)], "uid long, source_uid long, shift int, a int, b int")
    stored, store = [], suffix_dedup.materialise
    monkeypatch.setattr(suffix_dedup, "materialise", lambda df, name, *rest: (stored.append(name), store(df, name, *rest))[1])
    got = [tuple(r) for r in suffix_dedup._grown(index, match).collect()]
    suffix_dedup.discard(index)
    assert got == [(1, 20, 6020, 0, 11)]
    assert stored.count("sparse-extended") <= 4 and set(stored) == {"sparse-runs", "sparse-extended"}


def test_text_of_one_word(spark):
    """Each of its suffixes is a match on a diagonal of its own that goes on to the end."""
    table = spark.createDataFrame([(1, "w " * 32_000)], "doc_id long, text string")
    assert [tuple(r) for r in suffix_dedup.repeat_report(table).collect()] == [(1, 1, 31_999, 1, 0)]


def test_passages_bound_their_batches(spark, docs):
    """Workers of op 7 make several 64-bit values of a word, so they get smaller batches than others."""
    suffix_dedup.prepare(spark)
    suffix_dedup.repeat_report(docs)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 2_000_000


def test_common_prefixes_against_brute_force():
    rng = random.Random(3)
    rows = sorted({(rng.randint(0, 2), bytes(x for _ in range(rng.randint(0, 24)) for x in (0, rng.randint(0, 1), 0, 0))) for _ in range(400)})
    got = suffix_dedup.common_prefixes(np.array([k for k, _ in rows]), pa.array([n for _, n in rows], pa.binary()))
    assert got[0] == 0
    for (k, a), (m, b), common in zip(rows, rows[1:], got[1:]):
        words = [[x[i : i + 4] for i in range(0, len(x), 4)] for x in (a, b)]
        want = next((i for i, (x, y) in enumerate(zip(*words)) if x != y), min(map(len, words)))
        assert common == (suffix_dedup.KEY + want if k == m else 0)


@pytest.mark.parametrize("rows", [40_000, 30])
def test_passages_against_brute_force(spark, monkeypatch, rows):
    """Every window of 50 words that occurs before, in one sorted partition and across many."""
    monkeypatch.setattr(suffix_dedup, "SORTED_ROWS", rows)
    rng = random.Random(5)
    own = lambda n: [f"w{rng.getrandbits(40)}" for _ in range(n)]
    passages, texts = [own(rng.randint(50, 200)) for _ in range(6)], []
    for _ in range(120):
        t = own(rng.randint(0, 60))
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.randint(0, len(p) - 26)
            a, b = (0, len(p)) if rng.random() < 0.5 else (a, rng.randint(a + 26, len(p)))
            t += p[a:b] + own(rng.randint(0, 30))
        texts.append(t)
    texts += [texts[3], texts[4], texts[5] * 2]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    text = dict(zip(ids, texts))
    table = spark.createDataFrame([(i, " ".join(t), "k", 1) for i, t in text.items()], "doc_id long, text string, key string, pos int").repartition(5)
    got, seen, want = collections.defaultdict(set), set(), collections.defaultdict(set)
    for r in suffix_dedup.repeat_report(table).collect():
        a, b, n = r["start_word"], r["source_start_word"], r["n_words"]
        assert n >= 50 and text[r["doc_id"]][a : a + n] == text[r["source_doc_id"]][b : b + n] and (r["source_doc_id"], b) < (r["doc_id"], a)
        got[r["doc_id"]] |= set(range(a, a + n))
    for i in sorted(text):
        for k in range(len(text[i]) - 49):
            if (window := tuple(text[i][k : k + 50])) in seen:
                want[i] |= set(range(k, k + 50))
            seen.add(window)
    assert len(want) > 50 and got == want


def test_every_repeat_selects_a_common_position():
    body = np.array([RNG.getrandbits(63) for _ in range(50)], np.uint64)
    for _ in range(20):
        parts = [np.concatenate([np.array([RNG.getrandbits(63) for _ in range(RNG.randint(0, 60))], np.uint64), body]) for _ in range(2)]
        at = [set(suffix_dedup.selected(p, np.array([0, len(p)])) - (len(p) - 50)) for p in parts]
        assert any(0 <= x <= 50 - suffix_dedup.KEY for x in at[0] & at[1])


def test_context_tree(docs, table, empty):
    got = ctw.score_report(docs).collect()
    assert len(got) == len(table)
    train = [r for r in table if zlib.crc32(str("" if r[0] is None else r[0]).encode()) % 5 != 1]
    lower = lambda t: (t or "").translate({i: i + 32 for i in range(65, 91)})
    counts = collections.Counter(w for r in train for w in words(lower(r[1])))
    total, distinct, ends = sum(counts.values()) + len(train), len(counts) + 1, len(train)
    text = {r[0]: r[1] for r in table}
    for r in got:
        own = words(lower(text[r["doc_id"]]))
        base = sum(np.log10((counts[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in own) + np.log10((ends + 0.5) / (total + 0.5 * (distinct + 1)))
        assert r["n_tokens"] == len(own) + 1 and r["n_known"] == sum(w in counts for w in own) + 1 and r["train_tokens"] == total
        assert abs(r["base_score"] - base) < 1e-6 and r["score"] < 0
    shards = {(r["doc_id"], round(r["score"], 6), round(r["base_score"], 6)) for r in ctw.score(docs, langid.key_crc(5) != 1, chunk_bytes=20_000).collect()}
    assert shards == {(r["doc_id"], round(r["score"], 6), round(r["base_score"], 6)) for r in got}
    assert ctw.score_report(empty).count() == 0


def test_context_tree_mixes_contexts_seen_once(spark):
    training, held = ["abracadabra", "the cat sat", "zyx"], ["abracad", "a cat", "zyx", "q"]
    seen: dict = collections.defaultdict(lambda: [0, 0])

    def path(padded: bytes, i: int):
        for b in range(8):
            node = 1 << b | padded[i] >> (8 - b)
            yield [(padded[i - d : i], node) for d in range(ctw.DEPTH + 1)], padded[i] >> (7 - b) & 1

    pad = lambda t: bytes(ctw.DEPTH) + t.encode() + b"\0"
    for t in training:
        for i in range(ctw.DEPTH, len(pad(t))):
            for keys, bit in path(pad(t), i):
                for key in keys:
                    seen[key][bit] += 1
    log_kt = lambda n: math.lgamma(n[0] + 0.5) + math.lgamma(n[1] + 0.5) - math.log(math.pi) - math.lgamma(sum(n) + 1)
    below, weighted, own = collections.defaultdict(float), {}, {}
    for key in sorted(seen, key=lambda k: -len(k[0])):
        block, deepest = log_kt(seen[key]), len(key[0]) == ctw.DEPTH
        weighted[key] = block if deepest else np.logaddexp(block, below[key]) - math.log(2)
        own[key] = 1.0 if deepest else math.exp(block - math.log(2) - weighted[key])
        if key[0]:
            below[key[0][1:], key[1]] += weighted[key]
    want = []
    for t in held:
        total = 0.0
        for i in range(ctw.DEPTH, len(pad(t))):
            for keys, bit in path(pad(t), i):
                p, left, kt = 0.0, 1.0, 0.5
                for key in keys:
                    if key not in seen:
                        break
                    kt = (seen[key][1] + 0.5) / (sum(seen[key]) + 1)
                    p, left = p + left * own[key] * kt, left * (1 - own[key])
                p += left * kt
                total += math.log10(p if bit else 1 - p)
        want.append(total)
    rows = [(i, t) for i, t in enumerate(training + held)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    for chunk_bytes in (ctw.CHUNK_BYTES, 10):
        got = {r["doc_id"]: r["score"] for r in ctw.score(table, F.col("doc_id") < len(training), chunk_bytes).collect()}
        assert np.allclose([got[len(training) + i] for i in range(len(held))], want, atol=1e-9)


def test_near_duplicates(docs, table, empty):
    got = dartminhash.class_report(docs).collect()
    assert len(got) == len(table)
    group = near_groups([r[1] for r in table])
    ids = collections.defaultdict(list)
    for g, r in zip(group, table):
        ids[g].append(r[0])
    want = [(i, min((x for x in own if x is not None), default=None), len(own)) for own in ids.values() for i in own]
    same([(r["doc_id"], r["class_id"], r["class_size"]) for r in got], want)
    assert sum(r["kept"] for r in got) == len(ids)
    left = dartminhash.keep_one(docs)
    assert left.columns == docs.columns and left.count() == len(ids)
    assert dartminhash.class_report(empty).count() == 0


def test_signature_agreement_estimates_similarity():
    a = np.unique(np.array([RNG.getrandbits(62) for _ in range(900)], np.uint64))
    x, y = np.sort(a[:700]), np.sort(a[200:])
    sig = dartminhash.signatures(np.concatenate([x, y]), np.ones(len(x) + len(y), np.int64), np.array([0, len(x), len(x) + len(y)]), 400)
    assert abs((sig[0] == sig[1]).mean() - len(np.intersect1d(x, y)) / len(np.union1d(x, y))) < 0.08


def test_fingerprints(docs, table, empty, spark):
    got = fingerprint.edit_report(docs).collect()
    assert len(got) == len(table)
    by = collections.defaultdict(set)
    for r in fingerprint.fingerprints(docs.select("doc_id", "text")).collect():
        by[r["doc_id"]].add(r["fingerprint"])
    assert all(r["fingerprint"] in by[r["doc_id"]] and 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    order = sorted(table, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    want = []
    for k, r in enumerate(order):
        t, nxt = r[1] or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        want.append((r[0], len(t), hashlib.sha256((t[: len(t) - half] + nxt[:half]).encode()).hexdigest()))
    same([(r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got], want)
    rows = spark.createDataFrame([("a b c", "d e", "a b c\nd e", "d e\na b c")], "p string, q string, pq string, qp string")
    f = lambda c: fingerprint.fingerprints(rows.selectExpr("1 as doc_id", f"{c} as text")).first()["fingerprint"]
    assert f("pq") == f("qp") != f("p")
    both = spark.createDataFrame([(f("p"), f("q"), f("pq"))], "p string, q string, pq string")
    assert both.select(fingerprint.combine(both.p, both.q).alias("x")).first()["x"] == f("pq")
    assert both.select(fingerprint.combine(both.pq, both.q, -1).alias("x")).first()["x"] == f("p")
    assert fingerprint.edit_report(empty).count() == 0


def test_fingerprint_likeness_estimates_shared_pairs(spark):
    rng = random.Random(8)
    rows, want = [], []
    for k in range(150):
        own = [[f"w{rng.getrandbits(30)}" for _ in range(rng.randint(2, 40))] for _ in range(20)]
        other = own[: k % 21] + [[f"w{rng.getrandbits(30)}" for _ in line] for line in own[k % 21 :]]
        pairs = [collections.Counter((a, b) for line in t for a, b in zip(line, line[1:] + [None])) for t in (own, other)]
        square = [sum(v * v for v in c.values()) for c in pairs]
        want.append(2 * sum(pairs[0][x] * pairs[1][x] for x in pairs[0]) / sum(square))
        rows.append((k, *["\n".join(" ".join(line) for line in rng.sample(t, len(t))) for t in (own, other)]))
    both = spark.createDataFrame(rows, "doc_id long, a string, b string")
    prints = [{r["doc_id"]: r["fingerprint"] for r in fingerprint.fingerprints(both.select("doc_id", F.col(c).alias("text"))).collect()} for c in "ab"]
    table = spark.createDataFrame([(k, prints[0][k], prints[1][k]) for k in range(150)], "doc_id long, a string, b string")
    (_, n1, c1), (_, n2, c2) = fingerprint.parse(table.a), fingerprint.parse(table.b)
    got = {r["doc_id"]: r["x"] for r in table.select("doc_id", fingerprint.likeness(n1, c1, n2, c2).alias("x")).collect()}
    off = np.array([got[k] - want[k] for k in range(150)])
    assert np.sqrt((off**2).mean()) < 0.1 and np.abs(off).max() < 0.35 and abs(off.mean()) < 0.05


def test_fingerprint_of_a_very_long_text(spark):
    """Counters go round, and texts that share nothing still look different."""
    rng = random.Random(9)
    rows = [(k, "\n".join(" ".join(str(rng.getrandbits(36)) for _ in range(500)) for _ in range(5_000))) for k in range(2)]
    (a, b) = [r["fingerprint"] for r in fingerprint.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    table = spark.createDataFrame([(a, b)], "a string, b string")
    (_, n1, c1), (_, n2, c2) = fingerprint.parse(table.a), fingerprint.parse(table.b)
    r = table.select(n1.alias("n"), fingerprint.likeness(n1, c1, n2, c2).alias("apart"), fingerprint.likeness(n1, c1, n1, c1).alias("same")).first()
    assert r["n"] == 2_500_000 and r["apart"] < 0.4 and r["same"] == 1


def test_hash_table():
    keys = np.unique(np.random.RandomState(1).randint(0, 2**62, 5000).astype(np.uint64))
    t = kernels.HashTable(keys)
    assert (t.find(keys) == np.arange(len(keys))).all() and (t.find(keys + np.uint64(1)) == -1).all()


def test_near_duplicates_in_a_large_bucket(spark, monkeypatch):
    """A chain of neighbours that are alike while its ends are not, in buckets of many members."""
    body = prose(160).split()
    rows = [(i, " ".join(body[:i] + [f"n{j}" for j in range(i)] + body[i:])) for i in range(0, 60, 2)]
    monkeypatch.setattr(dartminhash, "SMALL", 2)
    monkeypatch.setattr(dartminhash, "LEADERS", 1)
    monkeypatch.setattr(dartminhash, "BLOCK", 7)
    sets = {i: collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)) for i, t in rows if (w := t.split())}
    group = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if sum((sets[a] & sets[b]).values()) >= 0.8 * sum((sets[a] | sets[b]).values()):
                low, high = sorted((group[a], group[b]))
                group = {k: low if g == high else g for k, g in group.items()}
    got = dartminhash.class_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["class_id"] for r in got} == group
