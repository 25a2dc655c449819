"""python -m quillon compress | restore | stream-compress | convert | info | version

Exit codes: 0 done, 1 refused or failed, 2 wrong usage.
"""

from __future__ import annotations

import argparse
import json
import os
import sys

from quillon.plans import codec

VERSION = "0.1"


def _arguments() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="quillon", description="Strict tables, stored losslessly.")
    commands = top.add_subparsers(dest="command", required=True)

    def add(name: str, what: str, *names: str) -> argparse.ArgumentParser:
        p = commands.add_parser(name, help=what, description=what)
        for n in names:
            p.add_argument(n)
        return p

    for name, what in (("compress", "store a table as an archive"), ("stream-compress", "store a table in blocks that fit a budget")):
        p = add(name, what, "file")
        p.add_argument("-o", "--output")
        p.add_argument("--encoding")
        p.add_argument("--no-verify", action="store_true")
        p.add_argument("--rows", type=int, help="rows of a block")
        if name == "stream-compress":
            p.add_argument("--budget", type=float, default=1.0, help="GB for the blocks at work")
    add("restore", "write an archive's table to a file, by the file's ending", "archive").add_argument("-o", "--output")
    add("convert", "read a table and write it in another format", "source", "target").add_argument("--encoding")
    add("info", "what an archive holds", "archive").add_argument("--json", action="store_true")
    add("version", "the version")
    return top


def _session():
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("quillon").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    return spark


def _planned(table, budget: float, verify: bool) -> int:
    """Rows of a block by the budget: a quarter of it for each of four blocks at work."""
    from pyspark.sql import functions as F

    from quillon.operators import blocks

    columns = [f"c{i}" for i in range(len(table.names))]
    return blocks.planned_rows(blocks.row_bytes(table.rows.select(F.col("rid"), *columns), "rid"), int(budget * 1e9), 4, verify).first()["rows_per_block"]


#: Formats whose files are kept as their bytes.
ORIGINALS = ("dta", "sav", "zsav", "xpt", "por", "sas7bdat")


def run(arguments: argparse.Namespace) -> None:
    if arguments.command == "version":
        print(VERSION)
        return
    from quillon.plans import archive, originals
    from quillon.sources import stats, writers
    from quillon.sources.bytes_in import Refused, format_of

    spark = _session()
    if arguments.command in ("compress", "stream-compress"):
        target = arguments.output or f"{arguments.file}.qln"
        if format_of(arguments.file) in ORIGINALS:  # their bytes are kept, so that they come back as they are
            originals.write_originals(spark, arguments.file, target)
            print(f"{target}: the original bytes of {arguments.file}")
            return
        table = writers.read_table(spark, arguments.file, arguments.encoding)
        verify = not arguments.no_verify
        rows = arguments.rows or (_planned(table, arguments.budget, verify) if arguments.command == "stream-compress" else archive.ROWS_PER_BLOCK)
        archive.write_archive(table, target, rows, verify)
        found = archive.info(spark, target)
        print(f"{target}: {found['rows'] or 0:,} rows, {found['blocks']:,} blocks, {found['bytes'] or 0:,} bytes")
    elif arguments.command == "restore":
        target = arguments.output or arguments.archive.removesuffix(".qln")
        if os.path.exists(target) and not arguments.output:
            raise Refused(f"{target} is there already; name another file with -o")
        if format_of(target) in ORIGINALS:
            found = originals.read_originals(spark, arguments.archive).first()
            part = f"{target}.part"
            with open(part, "wb") as f:
                f.write(found["content"])
            os.replace(part, target)
            return
        writers.write_table(archive.read_archive(spark, arguments.archive), target)
    elif arguments.command == "convert":
        kinds = ("dta", "sav", "zsav", "xpt", "por")
        if format_of(arguments.source) in kinds and format_of(arguments.target) in kinds:
            out = stats.translate(spark, arguments.source, format_of(arguments.target)).first()
            part = f"{arguments.target}.part"
            with open(part, "wb") as f:
                f.write(out["data"])
            os.replace(part, arguments.target)
            for what, n in json.loads(out["lost"]).items():
                print(f"lost: {what} ({n})")
        else:
            writers.convert(spark, arguments.source, arguments.target, arguments.encoding)
            if format_of(arguments.source) in kinds:
                for what, n in stats.text_losses(spark, arguments.source):
                    print(f"lost: {what} ({n})")
    else:
        found = archive.info(spark, arguments.archive)
        print(json.dumps(found) if arguments.json else "\n".join(f"{k}: {v}" for k, v in found.items()))


def main(argv: list[str] | None = None) -> int:
    try:
        arguments = _arguments().parse_args(argv)
    except SystemExit as e:
        return int(e.code or 0)
    try:
        run(arguments)
    except (ValueError, OSError, codec.Damaged) as e:
        print(f"quillon: {e}", file=sys.stderr)
        return 1
    except Exception as e:  # what a task refused comes back as Spark's own error
        refused = [line for line in str(e).splitlines() if "Refused: " in line or "Damaged: " in line]
        print(f"quillon: {refused[-1].split(': ', 1)[1] if refused else str(e).splitlines()[0]}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
