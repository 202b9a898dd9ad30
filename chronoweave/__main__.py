"""Command line: convert, run, query, list.

    python -m chronoweave convert PATH... [--sink text.pretty] [--params a=1,b=x] [--begin T] [--end T] [--timerange B,E] [--stream-intersection] [--debug-info]
    python -m chronoweave run --component NAME:KIND.CLASS[:PARAMS]... --connect UP:DOWN...
    python -m chronoweave query KIND.CLASS QUERY [--params ...]
    python -m chronoweave list
"""

from __future__ import annotations

import argparse
import json
import sys

from .plans import facade, graph, params


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("chronoweave").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _show(result, order: str = "pos") -> None:
    if result is None:
        return
    if isinstance(result, (str, int, float)):
        print(result)
    elif hasattr(result, "toLocalIterator"):
        for row in result.orderBy(order).toLocalIterator():
            print(row["line"])
    else:
        print(json.dumps(result, indent=2, default=str))


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="chronoweave", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("--plugin-path", action="append", default=[])
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("convert")
    c.add_argument("inputs", nargs="+")
    c.add_argument("--sink", default="text.pretty")
    c.add_argument("--params", default="")
    c.add_argument("--begin")
    c.add_argument("--end")
    c.add_argument("--timerange")
    c.add_argument("--stream-intersection", action="store_true")
    c.add_argument("--debug-info", action="store_true")
    r = sub.add_parser("run")
    r.add_argument("--component", action="append", default=[])
    r.add_argument("--connect", action="append", default=[])
    q = sub.add_parser("query")
    q.add_argument("cls")
    q.add_argument("object")
    q.add_argument("--params", default="")
    sub.add_parser("list")
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    graph.load_plugins(a.plugin_path)
    if a.command == "list":
        for kind, name, text in graph.list_components():
            print(f"{kind}.{name}: {text}")
        return 0
    spark = _session()
    try:
        if a.command == "convert":
            begin, end = facade.split_timerange(a.timerange) if a.timerange else (a.begin, a.end)
            _show(facade.convert(spark, a.inputs, a.sink, params.parse_params(a.params), begin, end, a.stream_intersection, a.debug_info))
        elif a.command == "run":
            g = graph.Graph(spark)
            for text in a.component:
                name, cls, *rest = text.split(":", 2)
                kind, _, cls = cls.partition(".")
                g.add(name, kind, cls, params.parse_params(rest[0]) if rest else {})
            for text in a.connect:
                g.connect(*text.split(":", 1))
            for result in g.run().values():
                _show(result)
        else:
            kind, _, cls = a.cls.partition(".")
            _show(graph.run_query(spark, kind, cls, a.object, params.parse_params(a.params)))
    except (graph.GraphError, ValueError) as e:
        at: BaseException | None = e
        while at is not None:
            print(f"{type(at).__name__}: {at}", file=sys.stderr)
            at = at.__cause__
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
