"""``python -m quire CORPUS REQUEST [name=value ...]``: a request's answer, or its error, as one JSON line.

Values are JSON where they parse as such, else text: ``python -m quire /data/corpus scan query="some words" limit=5``.
``verify`` (counts of broken rules) and ``info`` (rows of the main tables) are requests too. A folder of commits (``create``) also
takes the requests that change it: ``python -m quire /data/corpus save_finding title=T description=D body_file=finding.md``. Texts may
come from files, ``NAME_file=PATH``. Exit code 1 tells of an error.
"""

from __future__ import annotations

import json
import sys

from pyspark.sql import SparkSession

from quire import api
from quire.errors import EngineError
from quire.operators import integrity, views
from quire.sources import corpus as c
from quire.sources.store import Store
from quire.writes import WRITES


def _value(text: str):
    try:
        return json.loads(text)
    except ValueError:
        return text


def _texts(named: dict) -> dict:
    """Arguments with what ``NAME_file`` names read in."""
    out = {}
    for k, v in named.items():
        if not k.endswith("_file"):
            out[k] = v
            continue
        try:
            with open(v, encoding="utf-8") as f:
                out[k.removesuffix("_file")] = f.read()
        except OSError as wrong:
            raise EngineError(f"{k.upper()}_NOT_FOUND", f"cannot read {v}") from wrong
    return out


def respond(spark: SparkSession, argv: list[str]) -> dict:
    """The envelope for a command line."""
    requests = api.REQUESTS | {"info": lambda k: {"rows": {r["name"]: r["n"] for r in views.corpus_info(k).collect()}}, "verify": lambda k: {"violations": {r["rule"]: r["n"] for r in integrity.violations(k).collect()}}}

    def run() -> dict:
        if len(argv) < 2 or argv[1] not in {*requests, *WRITES} or not all("=" in a for a in argv[2:]):
            raise EngineError("USAGE_ERROR", __doc__.split("\n")[0], known=sorted([*requests, *WRITES]))
        named = _texts({k: _value(v) for k, _, v in (a.partition("=") for a in argv[2:])})
        store = Store(spark, argv[0])
        try:
            if argv[1] in WRITES:
                return WRITES[argv[1]](store, **named)
            return requests[argv[1]](store.corpus() if store.versions() else c.open_corpus(spark, argv[0]), **named)
        except TypeError as wrong:
            raise EngineError("USAGE_ERROR", str(wrong)) from wrong

    return api.answer(run)


def main() -> None:
    out = respond(SparkSession.builder.appName("quire").getOrCreate(), sys.argv[1:])
    print(json.dumps(out, ensure_ascii=False, default=str))
    sys.exit(1 if "code" in out else 0)


if __name__ == "__main__":
    main()
