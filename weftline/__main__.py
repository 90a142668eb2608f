"""``python -m weftline FLOW [--run OUT] [--base DIR]``: analyse a workflow document, or run it.

Without ``--run`` no data is needed: sources that can't be read have the fields the document tells of them. Prints JSON."""

from __future__ import annotations

import argparse
import json

from weftline.plans.compiler import compile_workflow
from weftline.plans.document import load
from weftline.plans.graph import Graph
from weftline.session import build_session


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="weftline", description=__doc__)
    p.add_argument("flow")
    p.add_argument("--base", default="")
    p.add_argument("--run", metavar="OUT")
    args = p.parse_args(argv)
    flow = load(args.flow)
    spark = build_session()
    spark.sparkContext.setLogLevel("ERROR")
    done = compile_workflow(flow, spark, base=args.base, offline=not args.run)
    if args.run:
        done.write(args.run)
    rows = lambda df: [r.asDict() for r in df.collect()]
    print(
        json.dumps(
            {
                "workflow": flow.as_dict()["metadata"], "order": Graph(flow).order(), "blocked": sorted(done.blocked), "tools": rows(done.tools_frame()), "diagnostics": rows(done.diagnostics_frame()),
                "dependencies": rows(done.dependencies_frame()), "lineage": rows(done.lineage_frame()), "schemas": {f"{i}.{a}": dict(s.df.dtypes) for (i, a), s in done.streams.items()},
            },
            default=str,
        )
    )
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
