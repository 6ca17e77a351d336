"""Every query of the library's own operators, with its SQL."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "ranked_queue"


def query(sql: str | None = None):
    """Registers a function of (spark, sf_dir) under its name, and the SQL that gives the same rows."""

    def add(function):
        if function.__name__ in QUERIES:
            raise ValueError(f"there is a query named {function.__name__} already")
        QUERIES[function.__name__] = function
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return add


from tidewire.plans import articles, audits, changelogs, cleaning, dictionary, discovery, editorial, evidence, feeds, frontiers, funnels, gates, links, newsroom, pagejson, queues, records, sourcetexts, texts  # noqa: E402, F401
