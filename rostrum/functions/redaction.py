"""Secrets in text that comes in chunks, and delays that servers ask for."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARK = "<REDACTED>"


class Automaton:
    """All secrets in one machine: a node for every beginning of one, and where to go on when a character doesn't fit."""

    def __init__(self, secrets: list[str]):
        self.next: list[dict[str, int]] = [{}]
        self.depth, self.longest = [0], [0]
        for secret in secrets:
            node = 0
            for c in secret:
                if c not in self.next[node]:
                    self.next[node][c] = len(self.next)
                    self.next.append({})
                    self.depth.append(self.depth[node] + 1)
                    self.longest.append(0)
                node = self.next[node][c]
            self.longest[node] = len(secret)
        self.fall = [0] * len(self.next)
        waiting = list(self.next[0].values())
        for node in waiting:  # grows while it is read: nearer nodes first
            for c, child in self.next[node].items():
                self.fall[child] = self.step(self.fall[node], c)
                self.longest[child] = max(self.longest[child], self.longest[self.fall[child]])
                waiting.append(child)

    def step(self, node: int, c: str) -> int:
        while node and c not in self.next[node]:
            node = self.fall[node]
        return self.next[node].get(c, 0)


class Redactor:
    """Replaces secrets in a stream of chunks: the one that begins first, of those the longest, and on behind it.

    What may still become a secret, or a longer one, is held back until a later chunk tells: no more than the longest secret has.
    """

    def __init__(self, secrets: str | list[str], held: str = ""):
        self.machine = Automaton([s for s in ([secrets] if isinstance(secrets, str) else secrets) if s])
        self.held = held

    def feed(self, chunk: str, last: bool = False) -> str:
        text, machine = self.held + chunk, self.machine
        out, done, at, node, found = [], 0, 0, 0, None
        while at < len(text) or (last and found):
            if at < len(text):
                node, at = machine.step(node, text[at]), at + 1
                start = at - machine.longest[node]
                if machine.longest[node] and (found is None or start <= found[0]):
                    found = start, at
            if found and (at - machine.depth[node] > found[0] or (last and at == len(text))):
                out += [text[done : found[0]], MARK]
                done = at = found[1]
                node, found = 0, None
        keep = len(text) if last else min(at - machine.depth[node], found[0] if found else at)
        self.held = "" if last else text[keep:]
        return "".join([*out, text[done:keep]])


def redacted_chunks(chunks: DataFrame, secrets: str | list[str]) -> DataFrame:
    """stream, pos, text of chunks (stream, pos, text): a secret that spans chunks is replaced in the one where it is told."""

    def run(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("pos")
        redactor = Redactor(secrets)
        texts = [redactor.feed(t or "", k == len(own) - 1) for k, t in enumerate(own.text)]
        return pd.DataFrame({"stream": own.stream, "pos": own.pos, "text": texts})

    return chunks.select("stream", "pos", "text").groupBy("stream").applyInPandas(run, "stream long, pos long, text string")


def retry_after_ms(value: Column, now: Column) -> Column:
    """Milliseconds that a Retry-After header asks to wait: whole seconds, or an HTTP date after ``now``; null if neither."""
    text = F.trim(value)
    seconds = F.when(text.rlike("^[0-9]+$"), text.try_cast("long") * 1000)
    stripped = F.regexp_extract(text, "^[A-Z][a-z]{2}, ([0-9]{2} [A-Z][a-z]{2} [0-9]{4} [0-9]{2}:[0-9]{2}:[0-9]{2}) GMT$", 1)
    date = F.when(stripped != "", F.try_to_timestamp(stripped, F.lit("dd MMM yyyy HH:mm:ss")))
    return F.coalesce(seconds, F.when(date.isNotNull(), F.greatest(F.unix_millis(date) - F.unix_millis(now), F.lit(0))))
