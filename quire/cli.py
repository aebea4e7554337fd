"""The commands of a library on the command line: ``python -m quire.cli --root FOLDER COMMAND``.

Every reading command prints JSON lines with ``--json``; failures leave with code 1.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire import commands
from quire.library import Library, libraries, resolve
from quire.operators import identity, maintain
from quire.session import session
from quire.sources import files


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quire")
    p.add_argument("--root", required=True)
    p.add_argument("-L", "--library")
    p.add_argument("--json", action="store_true")
    p.add_argument("--master", default="local[*]")
    p.add_argument("--tables", help="folder of answers: see quire.commands")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, *names: str, **options):
        s = sub.add_parser(name)
        for n in names:
            s.add_argument(n, **options.get(n.lstrip("-").replace("-", "_"), {}))
        return s

    many, number = {"nargs": "*"}, {"type": int}
    filters = ("--level", "--tag", "--year-from", "--year-to", "--status")
    numbers = {"year_from": number, "year_to": number, "limit": number}
    add("new", "name", "--scope", scope={"default": ""})
    for name in ("libs", "info", "reindex", "path", "unread", "links", "mine", "audit"):
        add(name)
    add("ls", *filters, "--sort", "--limit", sort={"default": "level"}, **numbers)
    add("search", "query", *filters, "--limit", "--exact", exact={"action": "store_true"}, **numbers)
    add("show", "keys", "--brief", keys=many, brief={"action": "store_true"})
    add("abstract", "key")
    add("note", "key", "text", "--append", append={"action": "store_true"})
    add("delete", "keys", keys=many)
    add("cite", "keys", "--form", "--level", "--tag", keys=many, form={"default": "bibtex"})
    add("export", "path", "keys", keys=many)
    add("import", "path", "--strategy", strategy={"default": "newer", "choices": ["skip", "replace", "newer"]})
    add("peek", "path")
    flag = {"action": "store_true"}
    add("use", "name")
    add("config", "setting", "value", setting={"nargs": "?"}, value={"nargs": "?"})
    add("find", "query", "--limit", "--year-from", "--year-to", **numbers)
    add("add", "--min-level", "--no-read", "--refresh", no_read=flag, refresh=flag)
    add("read", "keys", "--level", "--tag", keys=many)
    add("reread", "keys", keys={"nargs": "+"})
    for name in ("refresh", "inbox"):
        add(name)
    add("check", "--fix", fix=flag)
    add("code", "--force", "--unofficial", force=flag, unofficial=flag)
    add("ask", "question", "--read", "--level", "--tag", "--year-from", "--year-to", read={"type": int, "default": 5}, **numbers)
    add("claim", "keys", keys={"nargs": "+"})
    return p


def _defaults(root: str) -> dict:
    """Defaults of all libraries under ``root``."""
    store, path = files.opened(f"{root}/defaults.json")
    if not store.get_file_info(path).is_file:
        return {}
    with store.open_input_stream(path) as f:
        return json.loads(f.read())


def _set_default(root: str, name: str, value: str) -> None:
    store, path = files.opened(f"{root}/defaults.json")
    values = _defaults(root) | {name: value}
    with store.open_output_stream(path) as f:
        f.write(json.dumps(values).encode())


def _configure(spark, a: argparse.Namespace) -> str:
    """Shows or sets a library's settings; a setting keeps its kind."""
    lib = resolve(spark, a.root, a.library, _defaults(a.root).get("library"))
    held = lib.settings.__dict__
    if a.setting and a.setting not in held:
        raise ValueError(f"no setting {a.setting!r} among {sorted(held)}")
    if a.value is not None:
        if isinstance(held[a.setting], bool) and a.value not in ("true", "false"):
            raise ValueError(f"{a.setting} is true or false")
        made = {bool: lambda v: v == "true", dict: json.loads}.get(type(held[a.setting]), str)
        lib.save_settings(**{a.setting: made(a.value)})
    held = lib.settings.__dict__
    return json.dumps({a.setting: held[a.setting]} if a.setting else held, sort_keys=True)


def _show(rows: DataFrame, as_json: bool) -> None:
    lines = rows.toJSON() if as_json else rows.select(F.concat_ws("\t", *[F.col(c).cast("string") for c in rows.columns]).alias("line"))
    for r in lines.collect():
        print(r if as_json else r["line"])


def _run(a: argparse.Namespace, spark) -> None:
    if a.command == "new":
        return print(Library.create(spark, a.root, a.name, a.scope).folder)
    if a.command == "libs":
        return print("\n".join(libraries(spark, a.root)))
    if a.command == "use":
        resolve(spark, a.root, a.name)
        _set_default(a.root, "library", a.name)
        return print(a.name)
    if a.command == "config":
        return print(_configure(spark, a))
    lib = resolve(spark, a.root, a.library, _defaults(a.root).get("library"))
    if a.command in commands.NAMES:
        return _show(commands.run(a, lib, _this_year()), a.json)
    keep = {k: v for k in ("level", "tag", "year_from", "year_to", "status", "limit", "sort") if (v := getattr(a, k, None)) is not None}
    tables = {
        "info": lambda: lib.info(),
        "unread": lambda: lib.backlog().select("key", "level", "title"),
        "links": lambda: identity.link_references(lib.entries()).select("key", "linked"),
        "mine": lambda: _mined(lib),
        "audit": lambda: maintain.audit(lib.entries(), _this_year()),
        "ls": lambda: lib.ls(**keep).select("key", "level", "year", "status", "title"),
        "search": lambda: lib.search(a.query, stem=not a.exact, **keep),
        "show": lambda: lib.show(*a.keys, brief=a.brief),
        "abstract": lambda: lib.get(a.key).select("key", "abstract"),
        "cite": lambda: lib.cite(*a.keys, form=a.form, **keep),
        "import": lambda: lib.import_bundle(a.path, a.strategy),
    }
    if a.command in tables:
        return _show(tables[a.command](), a.json)
    if a.command == "note" and not lib.set_notes(a.key, a.text, append=a.append):
        raise ValueError(f"no entry {a.key}")
    done = {"reindex": lambda: lib.sync(force=True), "path": lambda: lib.folder, "delete": lambda: lib.delete(*a.keys), "export": lambda: lib.export(a.path, a.keys or None), "peek": lambda: lib.peek(a.path), "note": lambda: a.key}
    print(done[a.command]())


def _mined(lib: Library) -> DataFrame:
    from quire.operators.citations import mine_references

    return mine_references(lib.entries()).select("cited", "cocitations", "title", "year")


def _this_year() -> int:
    import datetime as dt

    return dt.date.today().year


def main(arguments: list[str] | None = None) -> int:
    a = _parser().parse_args(arguments)
    spark = session(a.master, spark__ui__enabled="false")
    spark.sparkContext.setLogLevel("ERROR")
    try:
        _run(a, spark)
    except (ValueError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
