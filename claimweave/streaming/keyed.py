"""Ingest with state by link: what a link has been through is kept with its key, so a batch reads nothing that was written before.

Spark keeps a row of state for each link (in RocksDB, which spills to disk and goes to the
checkpoint): its article while it waits for another try, then only that it is done. A failed
article has a timer, which tries it again after a pause that doubles each time; state can have a
time to live, after which a link counts as new.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from claimweave.functions.text import prompt
from claimweave.plans.models import STATUS, call, stub_extractor

STATE = "title STRING, summary STRING, text STRING, prompt STRING, tries INT, done BOOLEAN"
KEYED = f"link STRING, title STRING, summary STRING, text STRING, tries INT, {STATUS}"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class LinkExtractor(StatefulProcessor):
    """For each link: one extraction that succeeds, or ``tries`` that fail. Each try gives a row of ``KEYED``."""

    def __init__(self, make: Callable, tries: int, pause_ms: int, ttl_ms: int | None):
        self.make, self.tries, self.pause_ms, self.ttl_ms = make, tries, pause_ms, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.providers = handle, self.make()
        self.state = handle.getValueState("link", STATE, self.ttl_ms)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        first = min(rows, key=lambda r: (r.title or "", r.text or "", r.summary or ""))  # of rows that come together one, whatever their order
        if not self.state.exists():
            yield self._tried(key[0], (first.title, first.summary, first.text, first.prompt), 0, timerValues)

    def handleExpiredTimer(self, key: Any, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        held = self.state.get() if self.state.exists() else None
        if held is not None and not held[5]:
            yield self._tried(key[0], tuple(held[:4]), held[4], timerValues)

    def _tried(self, link: str, article: tuple, before: int, timer_values) -> Row:
        title, summary, text, asked = article
        got = call(asked or "", self.providers)
        tries = before + 1
        if got[0] == "ok" or tries >= self.tries:
            self.state.update((None, None, None, None, tries, True))
        else:
            self.state.update((title, summary, text, asked, tries, False))
            self.handle.registerTimer(timer_values.getCurrentProcessingTimeInMs() + self.pause_ms * 2**before)
        return Row(link=link, title=title, summary=summary, text=text, tries=tries, status=got[0], error=got[1], attempts=got[2], provider=got[3], reply=got[4], raw=got[5])

    def close(self) -> None:
        pass


def extract_by_link(
    articles: DataFrame, instructions: str = "Extract the claims.", make: Callable = lambda: [("stub", stub_extractor)], tries: int = 4, pause_ms: int = 60_000, ttl_ms: int | None = None
) -> DataFrame:
    """The stream of tries over a stream of articles (link, title, summary, text); articles without a link are left out.

    An article whose link has state is passed over. Write the stream in append mode; a try that
    fails and isn't the last is followed by others.
    """
    spark = articles.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    asked = articles.where(F.col("link").isNotNull()).select("link", "title", "summary", "text", prompt(instructions, F.col("title"), F.col("text")).alias("prompt"))
    return asked.groupBy("link").transformWithState(LinkExtractor(make, tries, pause_ms, ttl_ms), KEYED, "Append", "ProcessingTime")
