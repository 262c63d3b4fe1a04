"""Additions to a knowledge base from a stream of text triples, one version for each micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..model import RuleSet
from ..plans.store import KnowledgeBase
from ..sources.ntriples import parse


def triples(lines: DataFrame) -> DataFrame:
    """A stream of lines (value) as a stream of (s, p, o)."""
    return parse(lines).filter("ok").select("s", "p", "o")


def maintain(stream: DataFrame, kb: KnowledgeBase, rules: RuleSet, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Adds every micro-batch of (s, p, o). Stating a fact again changes nothing, so a replayed batch is harmless."""

    def apply(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            kb.add(batch, rules)

    writer = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
