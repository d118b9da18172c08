"""Many secrets in chunks and triggers against one replacement over the joined text."""

import random
import re

from rostrum.functions.redaction import MARK, Redactor
from rostrum.streaming import logs


def joined(text, secrets):
    wanted = sorted({s for s in secrets if s}, key=lambda s: (-len(s), s))
    return re.sub("|".join(map(re.escape, wanted)), MARK, text) if wanted else text


def test_chunks_give_what_the_joined_text_gives():
    rng = random.Random(11)
    for _ in range(3_000):
        secrets = ["".join(rng.choice("abc") for _ in range(rng.randrange(6))) for _ in range(rng.randrange(5))]
        text = "".join(rng.choice("abc") for _ in range(rng.randrange(40)))
        redactor, out, at = Redactor(secrets), "", 0
        while at < len(text):
            size = rng.randrange(1, 8)
            out += redactor.feed(text[at : at + size])
            assert len(redactor.held) <= max(map(len, secrets), default=0)
            at += size
        assert out + redactor.feed("", True) == joined(text, secrets), (secrets, text)


def test_overlapping_secrets_over_three_chunks_and_two_triggers(spark, tmp_path):
    secrets = ["secret", "cretin", "etc", "tinsel"]
    streams = {1: ["a sec", "ret in sec", "retinsel ", "se", "cretc"], 2: ["cre", "tinsel", "", None, "etc"], 3: ["secre"]}
    rows = [(k, pos, text, pos == len(parts) - 1) for k, parts in streams.items() for pos, text in enumerate(parts)]
    source, out = tmp_path / "in", f"{tmp_path}/out"
    for part in (rows[:2] + rows[5:6], rows[2:5] + rows[6:]):
        spark.createDataFrame(part, "stream long, pos long, text string, last boolean").write.mode("append").parquet(str(source))
        stream = logs.redacted(logs.parquet_tail(spark, str(source), "stream long, pos long, text string, last boolean"), secrets)
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    got = {}
    for r in spark.read.parquet(out).orderBy("stream", "pos").collect():
        got[r.stream] = got.get(r.stream, "") + r.text
    assert got == {k: joined("".join(p or "" for p in parts), secrets) for k, parts in streams.items()}
