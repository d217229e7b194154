"""Command line: ``python -m tidemark BASE TARGET``, ``python -m tidemark graph BASE TARGET``, ``--jsonl`` or ``--tools``.

Exit codes: 0 for an answer, 1 for a failure that a message on standard error names, 2 for wrong usage.
"""

from __future__ import annotations

import argparse
import sys

from .plans import reports
from .plans.answers import BadQuestion
from .plans.session import LineServer, Session
from .plans.tools import ToolServer
from .sources.git import GitError

RENDERED = {"text": ["diff"], "diff": ["diff"], "mermaid": ["mermaid"], "json": []}


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="tidemark", description="Compare two revisions of a repository.")
    out.add_argument("revisions", nargs="*", metavar="[graph] BASE TARGET")
    out.add_argument("--repository", default=".")
    out.add_argument("--format", choices=["human", "text", "diff", "mermaid", "json"])
    out.add_argument("--jsonl", action="store_true", help="answer one JSON request a line")
    out.add_argument("--tools", action="store_true", help="serve the questions as tools over JSON-RPC lines")
    for name in ("file", "function", "direction", "relations", "view"):
        out.add_argument(f"--{name}")
    for name in ("depth", "max-nodes", "max-edges"):
        out.add_argument(f"--{name}", type=int)
    return out


def graph_params(args: argparse.Namespace, form: str) -> dict:
    """The parameters of a graph question; their values are judged by whoever answers."""
    relations = [x.strip() for x in args.relations.split(",")] if args.relations is not None else None
    given = {"file": args.file, "function_id": args.function, "direction": args.direction, "relations": relations, "depth": args.depth, "view": args.view, "max_nodes": args.max_nodes, "max_edges": args.max_edges}
    return {k: v for k, v in given.items() if v is not None} | {"render": RENDERED[form]}


def run(args: argparse.Namespace, session: Session, lines=None) -> None:
    """Answer what was asked for on the command line."""
    write = sys.stdout.write
    if args.jsonl or args.tools:
        server = ToolServer(session.answer, args.repository) if args.tools else LineServer(session.answer)
        for line in server.serve(sys.stdin if lines is None else lines):
            write(line + "\n")
            sys.stdout.flush()
        return
    if args.revisions[0] == "graph":
        form = args.format or "text"
        answer = session.answer("get_impact_graph", args.repository, *args.revisions[1:], graph_params(args, form))
        if form in ("diff", "mermaid"):
            write(answer["data"]["dependency_diff" if form == "diff" else "mermaid"].rstrip("\n") + "\n")
        else:
            write(reports.graph_text(answer) if form == "text" else reports.json_text(answer))
        return
    analysis = session.analysis(args.repository, *args.revisions)
    write(reports.json_text(reports.document(analysis)) if args.format == "json" else reports.human(analysis))


def main(arguments: list[str] | None = None, session: Session | None = None) -> int:
    out = parser()
    args = out.parse_args(arguments)
    graph = args.revisions[:1] == ["graph"]
    if not (args.jsonl or args.tools) and len(args.revisions) != 2 + graph:
        out.error("a base and a target revision are required")
    if args.format and args.format not in (("text", "diff", "mermaid", "json") if graph else ("human", "json")):
        out.error(f"--format {args.format} is not one of this command's")
    if session is None:
        from pyspark.sql import SparkSession

        session = Session(SparkSession.builder.config("spark.ui.showConsoleProgress", "false").getOrCreate())
    try:
        run(args, session)
    except (BadQuestion, GitError) as e:
        print(f"tidemark: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
