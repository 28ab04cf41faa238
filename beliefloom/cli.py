"""python -m beliefloom.cli FOLDER COMMAND: queries over a folder of ledger tables.

    query 'CLAIMS WHERE score > 0.45'   the query language (plans/lql.py)
    verify | health | bars | matrix | prov | demo
    run NAME [--queries MODULE]         any registered query, or one of another module's QUERIES
"""

from __future__ import annotations

import argparse
import importlib
import json
import sys

from beliefloom.operators import audit, chain, fold, provenance
from beliefloom.plans import demo, lql, reference, registry
from beliefloom.session import session


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="beliefloom", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("folder")
    p.add_argument("command", choices=["query", "verify", "health", "bars", "matrix", "prov", "demo", "run"])
    p.add_argument("text", nargs="?")
    p.add_argument("--limit", type=int, default=50)
    p.add_argument("--queries", help="a module with more QUERIES, as optional subpackages have them")
    a = p.parse_args(argv)
    if a.command == "query":
        try:
            plan = lql.parse(a.text or "")  # before any session or job starts
        except lql.ParseError as e:
            print(e, file=sys.stderr)
            return 2
    spark = session()
    if a.command == "query":
        df = lql.execute(reference.ledger(spark, a.folder), plan)
    elif a.command == "verify":
        df = chain.chain_problems(reference.log(spark, a.folder)).orderBy("store", "seq")
    elif a.command == "health":
        df = audit.health(reference.log(spark, a.folder))
    elif a.command == "demo":
        df = demo.story(spark)
    elif a.command == "bars":
        df = reference.kill_bars(spark, a.folder)
    elif a.command == "matrix":
        df = fold.matrix(reference.log(spark, a.folder)).orderBy("store", "assert_seq")
    elif a.command == "prov":
        df = provenance.document(reference.log(spark, a.folder))
    else:
        every = registry.QUERIES | (importlib.import_module(a.queries).QUERIES if a.queries else {})
        if a.text not in every:
            print(f"no query {a.text!r}; there are {', '.join(sorted(every))}", file=sys.stderr)
            return 2
        df = every[a.text](spark, a.folder)
    rows = df.limit(a.limit).toJSON().collect()
    print("\n".join(rows))
    found = bool(rows)
    if a.command == "verify":
        print(json.dumps({"ok": not found}))
        return int(found)
    return 0


if __name__ == "__main__":
    sys.exit(main())
