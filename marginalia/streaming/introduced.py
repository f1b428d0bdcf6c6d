"""Running concept sets over a stream of paragraphs: which terms are used before a paragraph introduces them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def normal(term: str) -> str:
    """A term as it is compared: small, trimmed, without a plural s."""
    term = term.strip().lower()
    return term[:-1] if len(term) > 4 and term.endswith("s") and not term.endswith("ss") else term


def _scan(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    seen, at = (set(state.get[0]), state.get[1]) if state.exists else (set(), -1)
    rows = pd.concat(list(frames)).sort_values("ix")
    out = []
    for r in rows.itertuples():
        if int(r.ix) <= at:  # sent again, as after a restart of the source
            continue
        out += [(key[0], int(r.ix), t) for t in r.used if normal(t) not in seen]
        seen.update(normal(t) for t in r.introduced)
        at = int(r.ix)
    state.update((sorted(seen), at))
    yield pd.DataFrame(out, columns=["doc_id", "ix", "term"])


def forward_terms(paras: DataFrame) -> DataFrame:
    """``doc_id, ix, term`` of a stream (doc_id int, ix int, introduced, used) whose paragraphs arrive in order.

    The state of a document is the set of terms introduced so far, and the last paragraph seen; batches may cut a document
    anywhere, and a paragraph that comes again is passed over.
    """
    return paras.select("doc_id", "ix", "introduced", "used").groupBy("doc_id").applyInPandasWithState(_scan, "doc_id int, ix int, term string", "seen array<string>, at int", "append", GroupStateTimeout.NoTimeout)


def running_terms(paras: DataFrame) -> DataFrame:
    """``doc_id, at, terms`` of a table (doc_id, ix, introduced): the state that the stream ends in, with sorted normal terms."""
    from marginalia.functions.text import stem_plural

    rows = paras.select("doc_id", "ix", F.explode_outer("introduced").alias("t")).withColumn("t", stem_plural(F.lower(F.trim("t"))))
    return rows.groupBy("doc_id").agg(F.max("ix").alias("at"), F.array_sort(F.collect_set("t")).alias("terms"))
