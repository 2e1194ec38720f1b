"""The interactive terminal: statements are added to the branch, queries are answered, ``/-`` lines are commands."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable, Iterable
from pathlib import Path

from pyspark.sql import SparkSession

from credence.engine import Engine
from credence.functions.values import render_temporal
from credence.plans import syntax
from credence.plans.macros import Registry
from credence.prompt import extract_prompt, query_prompt, schema
from credence.sources.kb import DuplicateDeclaration, KnowledgeBase

HELP = """  dump [--json] [--file <path>] [--no-predicates] [--no-belief-records] [--no-rules] [--no-constraints]
  info | schema | load <file> [--fix] | search <text> | help | exit | quit
  unload predicate <name>/<arity> | unload entity <name> | unload rules | unload constraints | unload all"""
_TEMPORAL = ("date", "datetime", "timedelta")


def shown(v: object) -> str:
    return render_temporal(v) if type(v).__name__ in _TEMPORAL else repr(v)


def answer_lines(rows: Iterable[tuple[dict, float, float, str]]) -> list[str]:
    out = []
    for n, (bindings, b, d, status) in enumerate(rows, 1):
        values = ", ".join(f"{k}={shown(v)}" for k, v in sorted(bindings.items()))
        out.append(f"  {n}: {values} | b={b:.4g}, d={d:.4g}, status={status}" if values else f"  {n}: b={b:.4g}, d={d:.4g}, status={status}")
    return out or ["  No results."]


class Terminal:
    def __init__(self, engine: Engine, kb: KnowledgeBase | None = None, say: Callable[[str], None] = print):
        self.engine, self.kb, self.say = engine, kb or KnowledgeBase(), say
        self.registry, self.held = Registry(), ""

    def line(self, text: str) -> bool:
        """Take one line; False when the session ends."""
        stripped = text.strip()
        if not self.held and stripped.startswith("/-"):
            return self.command(stripped[2:].strip())
        if not stripped or stripped.startswith("%"):
            return True
        self.held += text + "\n"
        if stripped.endswith("."):
            held, self.held = self.held.strip(), ""
            try:
                self.query(held) if held.startswith("?-") else self.extend(held)
            except DuplicateDeclaration as e:
                self.say(f"  Merge error: {e}")
            except syntax.SyntaxProblem as e:
                self.say(f"  Parse error: {e}")
            except (ValueError, RuntimeError) as e:
                self.say(f"  Error: {e}")
        return True

    def extend(self, text: str) -> None:
        new = KnowledgeBase.parse(text, self.registry)
        self.kb = self.kb.merge(new)
        counts = (("predicate", new.predicates), ("fact", new.facts), ("rule", new.rules), ("constraint", new.constraints))
        self.say("  Added: " + ", ".join(f"{len(found)} {name}(s)" for name, found in counts if found))

    def query(self, text: str) -> None:
        for line in answer_lines(self.engine.evaluate(self.kb, text).rows()):
            self.say(line)

    def command(self, text: str) -> bool:
        name, *args = text.split() or [""]
        if name in ("exit", "quit"):
            self.say("  Goodbye.")
            return False
        run = getattr(self, f"do_{name}", None)
        if run is None:
            self.say(f"  Unknown command: {name}. Try /- help.")
            return True
        try:
            run(args)
        except (OSError, ValueError, KeyError, IndexError) as e:
            self.say(f"  Error: {e}")
        return True

    def do_help(self, args: list[str]) -> None:
        self.say(HELP)

    def do_info(self, args: list[str]) -> None:
        k = self.kb
        self.say(f"  engine: spark {self.engine.spark.version}, branch: {k.name}")
        self.say(f"  {len(k.predicates)} predicate(s), {len(k.facts)} fact(s), {len(k.bindings)} bound, {len(k.rules)} rule(s), {len(k.constraints)} constraint(s)")

    def do_dump(self, args: list[str]) -> None:
        parts = {p: f"--no-{flag}" not in args for p, flag in (("predicates", "predicates"), ("facts", "belief-records"), ("rules", "rules"), ("constraints", "constraints"))}
        text = self.kb.to_json() if "--json" in args else self.kb.render(**parts)
        if "--file" in args:
            Path(args[args.index("--file") + 1]).write_text(text + "\n", encoding="utf-8")
        else:
            self.say(text)

    def do_schema(self, args: list[str]) -> None:
        self.say(json.dumps(schema()))

    def do_load(self, args: list[str]) -> None:
        self.kb = self.kb.merge(KnowledgeBase.load(args[0], "--fix" in args))
        self.say(f"  Loaded {args[0]}.")

    def do_unload(self, args: list[str]) -> None:
        what = args[0]
        if what == "all":
            self.kb = KnowledgeBase(self.kb.name)
            self.say("  Branch reset to empty.")
        elif what == "predicate":
            name, arity = args[1].split("/")
            self.kb, n = self.kb.unload_predicate(name, int(arity))
            self.say(f"  Unloaded predicate {args[1]}: {n['declaration']} declaration(s), {n['fact']} fact(s), {n['rule']} rule(s) removed.")
        elif what == "entity":
            self.kb, n = self.kb.unload_entity(args[1])
            self.say(f"  Unloaded entity {args[1]}: {n} fact(s) removed.")
        elif what in ("rules", "constraints"):
            self.kb = self.kb.copy()
            n = len(getattr(self.kb, what))
            setattr(self.kb, what, [])
            self.say(f"  Unloaded {n} {what[:-1]}(s).")
        else:
            raise ValueError(f"can't unload {what}")

    def do_search(self, args: list[str]) -> None:
        found = self.kb.search(" ".join(args))
        lines = []
        for title, key in (("Predicates", "predicates"), ("Entities", "entities"), ("Belief records", "facts"), ("Rules", "rules"), ("Constraints", "constraints")):
            if found[key]:
                lines.append(f"  {title} ({len(found[key])}):")
                for x in found[key]:
                    text = x if isinstance(x, str) else x.render().split(" @{")[0] + (f"  — {x.description}" if x.description else "") if key == "predicates" else x.render()
                    lines.append(f"    {text}")
        for line in lines or ["  No matches."]:
            self.say(line)


def _written(text: str, path: str | None) -> None:
    if path:
        Path(path).write_text(text + "\n", encoding="utf-8")
    else:
        print(text)


def _loaded(files: list[str]) -> KnowledgeBase:
    kb = KnowledgeBase()
    for f in files:
        kb = kb.merge(KnowledgeBase.load(f))
    return kb


def _tools(argv: list[str]) -> int:
    """merge, schema, extract-prompt and query-prompt need no engine."""
    p = argparse.ArgumentParser(prog="credence")
    sub = p.add_subparsers(dest="tool", required=True)
    m = sub.add_parser("merge", help="write the merged program or JSON")
    m.add_argument("out")
    m.add_argument("files", nargs="*")
    sub.add_parser("schema", help="the JSON schema of a knowledge base").add_argument("--out")
    e = sub.add_parser("extract-prompt", help="a prompt for the statements that a text supports")
    e.add_argument("source", help="a file, or the text itself")
    e.add_argument("--json", action="store_true")
    q = sub.add_parser("query-prompt", help="a prompt for the query that answers a question")
    q.add_argument("question")
    for x in (e, q):
        x.add_argument("--file", action="append", default=[], help="program or JSON file that is known already")
        x.add_argument("--out")
    a = p.parse_args(argv)
    if a.tool == "merge":
        out = _loaded(a.files)
        _written(out.to_json() if a.out.endswith(".json") else out.render(), a.out)
    elif a.tool == "schema":
        _written(json.dumps(schema(), indent=1), a.out)
    elif a.tool == "extract-prompt":
        text = Path(a.source).read_text(encoding="utf-8") if Path(a.source).is_file() else a.source
        _written(extract_prompt(text, _loaded(a.file) if a.file else None, a.json), a.out)
    else:
        _written(query_prompt(a.question, _loaded(a.file)), a.out)
    return 0


def main(argv: list[str] | None = None) -> int:
    argv = sys.argv[1:] if argv is None else argv
    if argv[:1] and argv[0] in ("merge", "schema", "extract-prompt", "query-prompt"):
        return _tools(argv)
    p = argparse.ArgumentParser(prog="credence", description=__doc__)
    p.add_argument("--file", action="append", default=[], help="program or JSON file to load first")
    p.add_argument("--memory", "--edb", choices=["memory", "log"], help="where the branch is kept; log if --log is given")
    p.add_argument("--log", help="folder of the event log that holds the branch")
    p.add_argument("--tmp", action="store_true", help="keep nothing, whatever --memory says")
    p.add_argument("--engine", "--idb", choices=["spark"], default="spark", help="there is one engine")
    p.add_argument("--branch", default="main")
    a = p.parse_args(argv)
    if a.memory == "log" and not a.log and not a.tmp:
        p.error("--memory log needs --log")
    from credence.sources.log import EventLog, MemoryRepository, Repository

    spark = SparkSession.builder.appName("credence").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    store = Repository(EventLog(spark, a.log)) if a.log and not a.tmp and a.memory != "memory" else MemoryRepository()
    kb = store.get(a.branch) or KnowledgeBase(a.branch)
    for f in a.file:
        kb = kb.merge(KnowledgeBase.load(f))
    terminal = Terminal(Engine(spark), kb)
    for line in sys.stdin:
        if not terminal.line(line.rstrip("\n")):
            break
    store.save(terminal.kb)
    return 0


if __name__ == "__main__":
    sys.exit(main())
