"""Tools from the command line: ``python -m helixlake find-orfs --workspace w --molecule m --min-aa 30``.

Every tool is a command, every argument an option; lists and objects are JSON,
or ``--<name>-file`` names a JSON file (a byte order mark is skipped).  The
answer envelope goes to standard output; the exit status is 0 if it is ok.
"""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path
from typing import Any

from helixlake import tools


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="helixlake", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = out.add_subparsers(dest="command", required=True)
    for name, (schema, run) in sorted(tools.TOOLS.items()):
        own = commands.add_parser(name.replace("_", "-"), help=(run.__doc__ or "").split("\n")[0])
        for field in schema["properties"]:
            own.add_argument(f"--{field.replace('_', '-')}", dest=field)
            own.add_argument(f"--{field.replace('_', '-')}-file", dest=f"{field} file")
    return out


def arguments(name: str, given: dict[str, str | None]) -> dict[str, Any]:
    """Options as the tool's schema has them: texts stay, other types are JSON."""
    out: dict[str, Any] = {}
    for field, schema in tools.TOOLS[name][0]["properties"].items():
        text, file = given.get(field), given.get(f"{field} file")
        if file is not None:
            out[field] = json.loads(Path(file).read_text("utf-8-sig"))
        elif text is not None:
            out[field] = text if schema.get("type") == "string" else json.loads(text)
    return out


def main(argv: list[str] | None = None, spark=None) -> int:
    options = vars(parser().parse_args(argv))
    name = options.pop("command").replace("-", "_")
    try:
        own = arguments(name, options)
    except (OSError, ValueError) as e:
        answer = {"ok": False, "tool": name, "error": {"code": "INVALID_ARGUMENT", "message": str(e), "details": {}}}
    else:
        if spark is None:
            from pyspark.sql import SparkSession

            spark = SparkSession.builder.appName("helixlake").config("spark.ui.showConsoleProgress", "false").getOrCreate()
        answer = tools.call(spark, name, own)
    json.dump(answer, sys.stdout, indent=2, sort_keys=True, default=str)
    sys.stdout.write("\n")
    return 0 if answer["ok"] else 1


if __name__ == "__main__":
    sys.exit(main())
