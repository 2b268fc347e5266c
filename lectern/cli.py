"""The command line: python -m lectern.cli COMMAND."""

from __future__ import annotations

import argparse
import importlib
import json
import os
import sys
from collections.abc import Callable
from datetime import datetime
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from zoneinfo import ZoneInfo

from . import config, runs
from .service import Library, call
from .session import session
from .sources import pdf, providers


def _count(text: str) -> int:
    if int(text) < 0:
        raise argparse.ArgumentTypeError("must not be negative")
    return int(text)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lectern")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, *args: tuple) -> None:
        s = sub.add_parser(name)
        s.add_argument("--config")
        for flags, more in args:
            s.add_argument(*flags, **more)

    flag = {"action": "store_true"}
    filters = [(("--author",), {}), (("--year",), {"type": int}), (("--tag",), {}), (("--file-name",), {})]
    one, most, yes = (("--file",), {}), (("--max-files",), {"type": _count}), (("--yes",), flag)
    reader = (("--reader",), {"help": "module:function from the bytes of a file to (text, pages)"})
    limit = (("--limit",), {"type": _count, "default": 10})
    add("init-config", (("--path",), {"default": "config.json"}))
    add("index", one, most, yes, reader, (("--force",), flag), (("--only-new",), flag), (("--retry-failed",), flag), (("--update-metadata-only",), flag))
    add("enrich-metadata", one, most, yes, reader, (("--force",), flag), (("--reverify",), flag))
    add("list-papers", limit)
    add("show-paper", (("selector",), {}), limit, (("--all-chunks",), flag))
    add("delete-paper", (("selector",), {}), limit, yes)
    add("dedupe-papers", one, most, reader)
    add("build-citation-graph")
    add("search", (("query",), {}), (("--top-k",), {"type": int}), (("--group-by-paper",), flag), (("--max-text-chars",), {"type": int, "default": 800}), *filters)
    add("serve", (("--transport",), {"choices": ["stdio", "http"]}))
    return p


def shown_time(value: str | None, zone: str = "local", pattern: str = "") -> str:
    """A stored time as the settings show it: zone "local" or "system" is the machine's; without a pattern, ISO to the second.

    What is no time is shown as it is; a time without a zone is in UTC.
    """
    if not value:
        return ""
    try:
        at = datetime.fromisoformat(value.strip().replace("Z", "+00:00"))
        at = at if at.tzinfo else at.replace(tzinfo=ZoneInfo("UTC"))
        at = at.astimezone(None if zone.lower() in ("", "local", "system") else ZoneInfo(zone))
    except (ValueError, KeyError):
        return value
    return at.strftime(pattern) if pattern else at.isoformat(sep=" ", timespec="seconds")


def detail(paper: dict, display: config.Display) -> str:
    """A paper's lines; of its chunks those that ``show_paper`` left in, and how many it hid."""
    out = []
    for k, v in paper.items():
        if v in (None, "", []) or k in ("hidden_chunks", "first_seq"):
            continue
        if k == "chunk_ids":
            out += ["chunk_ids:", *(f"  {x}" for x in v)]
            if paper.get("hidden_chunks"):
                out.append(f"  ... {paper['hidden_chunks']} more hidden")
        else:
            shown = shown_time(v, display.timezone, display.datetime_format) if k.endswith("_at") else ", ".join(v) if isinstance(v, list) else v
            out.append(f"{k}: {shown}")
    return "\n".join(out)


def _agreed(question: str, yes: bool) -> bool:
    return yes or input(f"{question} [y/N] ").strip().lower() in ("y", "yes")


def _reader(name: str | None) -> Callable[[bytes], tuple]:
    if not name:
        return pdf.read
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def _embedder(s: config.Embedding):
    if s.provider == "hashing":
        return None
    key = os.environ.get(s.api_key_env, "") if s.provider == "openai" else ""
    return providers.embedder(providers.http(s.timeout_seconds, {"Authorization": f"Bearer {key}"} if key else None), s)


def handler(lib: Library) -> type[BaseHTTPRequestHandler]:
    """POST a request as JSON, get its answer; nothing else is served."""

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self) -> None:
            try:
                asked = json.loads(self.rfile.read(int(self.headers.get("Content-Length") or 0)))
                status, answer = 200, call(lib, asked) if isinstance(asked, dict) else {"error": "a request is a JSON object"}
            except ValueError as e:
                status, answer = 400, {"error": str(e)}
            body = json.dumps(answer, ensure_ascii=False, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json; charset=utf-8")
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_: object) -> None:
            pass

    return Handler


def main(argv: list[str] | None = None, transport: providers.Transport | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command == "init-config":
        config.write_default(args.path)
        return 0
    settings = config.load(args.config)
    spark, e = session(), settings.metadata_enrichment
    judge = providers.judge(providers.http(settings.reranker.timeout_seconds), settings.reranker) if settings.reranker.enabled else None
    lib = Library(spark, settings, _embedder(settings.embedding), judge)
    show = lambda x: print(json.dumps(x, ensure_ascii=False, indent=1, default=str))
    yes = getattr(args, "yes", False) or settings.indexing.assume_yes
    send = transport or providers.http(e.timeout_seconds, {"User-Agent": e.user_agent}, e.proxy)
    if args.command == "index" and args.update_metadata_only:
        show(runs.refresh(lib))
    elif args.command == "index":
        show(
            runs.index(
                lib, file=args.file, force=args.force, only_new=args.only_new, retry_failed=args.retry_failed, max_files=args.max_files, reader=_reader(args.reader), transport=send,
                confirm_plan=lambda plan: _agreed("\n".join(f"{r['root_path']}: {r['files']} files" for r in plan) + "\nindex these?", yes),
                confirm_markers=lambda dirs: _agreed("marked to be left out:\n" + "\n".join(dirs) + "\ngo on?", yes),
            )
        )
    elif args.command == "enrich-metadata":
        show(runs.enrich_files(lib, send, file=args.file, force=args.force, reverify=args.reverify, max_files=args.max_files, reader=_reader(args.reader), confirm=lambda n: _agreed(f"enrich {n} files?", yes)))
    elif args.command == "list-papers":
        show(lib.list_papers(args.limit))
    elif args.command == "show-paper":
        found = lib.show_paper(args.selector, args.limit, args.all_chunks)
        if not found:
            print(f"not indexed: {args.selector}", file=sys.stderr)
            return 1
        print("\n\n".join(detail(x, settings.display) for x in found))
    elif args.command == "delete-paper":
        if not _agreed(f"delete papers matching {args.selector!r}?", yes):
            return 1
        show(lib.delete(args.selector, args.limit))
    elif args.command == "dedupe-papers":
        show(runs.dedupe(lib, args.file, args.max_files, _reader(args.reader)))
    elif args.command == "build-citation-graph":
        show(lib.citation_graph())
    elif args.command == "search":
        filters = {k: v for k, v in (("author", args.author), ("year", args.year), ("tag", args.tag), ("file_name", args.file_name)) if v is not None}
        for row in lib.search(args.query, args.top_k, args.group_by_paper, args.max_text_chars, **filters):
            print(f"{row['rank']}. {row['title'] or row['file_name']}  {row['score']:.4f}\n{row['text']}\n")
    elif args.command == "serve" and (args.transport or settings.service.transport) == "http":
        with ThreadingHTTPServer((settings.service.host, settings.service.port), handler(lib)) as server:
            server.serve_forever()
    elif args.command == "serve":
        for line in sys.stdin:  # a request per line, an answer per line
            print(json.dumps(call(lib, json.loads(line)), ensure_ascii=False, default=str), flush=True)
    return 0


if __name__ == "__main__":
    sys.exit(main())
