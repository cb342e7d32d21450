"""Applying a caller's recognizer to segments.

Without conditioning, segments are independent rows. With it, the prompt of a segment is
the result of the one before, so a stream is walked in order; the walk is a pass over
sorted rows that keeps three short strings per stream, never a collected group. Where that
chain is too long, ``block_segments`` runs blocks of a stream side by side, or recognize
everything once without prompts and use the two-pass plan of ``voxframe.operators.scan``
(plan, recognize the planned rows again, splice).
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxframe.functions.text import (
    CJK_WIDE_CLASS, NEAR_DUPLICATE_RATIO, REPETITION_MIN_ITEMS, REPETITION_RATIO, WHITESPACE_CLASS, similar_texts,
)
from voxframe.schemas import TRANSCRIPTS
from voxframe.session import materialize

RATE = 16000
_MEMORY = "array<string>"

# fn(samples, prompt or None) -> list of {"text", "t0", "t1"}; t1 may be None.
Recognizer = Callable[[np.ndarray, str | None], list[dict]]


def _few_distinct(items: list[str]) -> bool:
    return len(items) >= REPETITION_MIN_ITEMS and len(set(items)) / len(items) < REPETITION_RATIO


_echoes = similar_texts(NEAR_DUPLICATE_RATIO)


def _ideograph(c: str) -> bool:
    return "\u4e00" <= c <= "\u9fff" or "\u3400" <= c <= "\u4dbf"


def _prompt_from(line: str, prior: str) -> str:
    text = line.strip()
    repeats = _few_distinct(text.lower().split()) or _few_distinct([c for c in text if _ideograph(c)])
    return "" if not text or repeats or _echoes(text, prior) else text


class Conversation:
    """What one stream remembers between segments."""

    def __init__(self, prior_line: str = "", prior_last_chunk: str = "", prompt: str = ""):
        self.prior_line, self.prior_last_chunk, self.prompt = prior_line, prior_last_chunk, prompt

    def echo_at(self, texts: list[str]) -> int | None:
        """Index of the first chunk that repeats its predecessor."""
        for i, (before, text) in enumerate(zip([self.prior_last_chunk, *texts], texts)):
            if _echoes(text, before):
                return i
        return None

    def lines(self) -> list[str]:
        return [self.prior_line, self.prior_last_chunk, self.prompt]

    def remember(self, texts: list[str], last: str | None = None):
        if texts:
            line = " ".join(texts)
            self.prompt = _prompt_from(line, self.prior_line)
            self.prior_line = line.strip()
            self.prior_last_chunk = (last if last is not None else texts[-1]).strip()


def recognize_one(
    fn: Recognizer, samples: np.ndarray, memory: Conversation, sub_timestamps: bool,
    convert: Callable[[str], str] | None = None, condition: bool = True, raw_memory: bool = False, rate: int = RATE,
) -> list[tuple[dict, bool]]:
    """Chunks of one segment with their retry flag; at most one second call."""
    prompt = memory.prompt or None
    chunks, first_retried = list(fn(samples, prompt)), None
    texts = [c["text"] for c in chunks]
    if sub_timestamps:
        i = memory.echo_at(texts)
        if i is not None and (i > 0 or prompt) and chunks[i]["t0"] is not None:
            at = chunks[i]["t0"]
            later = [
                {"text": c["text"], "t0": None if c["t0"] is None else c["t0"] + at, "t1": None if c["t1"] is None else c["t1"] + at}
                for c in fn(samples[int(at * rate):], None)
            ]
            chunks, first_retried = chunks[:i] + later, i
    elif prompt and texts and _echoes(" ".join(texts), memory.prior_line):
        chunks, first_retried = list(fn(samples, None)), 0
    raw = [c["text"] for c in chunks]
    if convert is not None:
        chunks = [{**c, "text": convert(c["text"])} for c in chunks]
    if condition:
        memory.remember(raw if raw_memory else [c["text"] for c in chunks], raw[-1] if raw else None)
    return [(c, first_retried is not None and k >= first_retried) for k, c in enumerate(chunks)]


def transcribe_segments(
    segments: DataFrame,
    recognizer: Callable[[], Recognizer],
    condition: bool = True,
    sub_timestamps: bool = True,
    convert: Callable[[str], str] | None = None,
    prior_text: str = "converted",
    block_segments: int | None = None,
) -> DataFrame:
    """Transcript rows of ``stream_id, segment_idx, start_s, samples``.

    ``recognizer`` builds the recognizing function once per task. Chunk times count from
    the segment's start; a missing end, or a family without chunk times, means the whole
    segment. ``convert`` is the script conversion; ``prior_text`` says whether the memory
    keeps converted or raw text.

    ``block_segments`` spreads a long conditioned stream over many tasks: blocks of that many
    segments run at the same time, and a block runs again if the memory it started from is
    not the one its predecessor ended with. The first block is right at once and every round
    settles at least one more, so the outcome is that of one walk over the stream.
    """
    if prior_text not in ("converted", "raw"):
        raise ValueError(f"prior_text must be 'converted' or 'raw', got {prior_text}")
    schema = T.StructType([segments.schema["stream_id"], *TRANSCRIPTS.fields[1:]])
    job = _Job(recognizer, condition, sub_timestamps, convert, prior_text)
    rows = segments.select("stream_id", "segment_idx", "start_s", "samples")
    if not condition or block_segments is None:
        if condition:
            rows = rows.repartition("stream_id").sortWithinPartitions("stream_id", "segment_idx")
        plain = rows.select("stream_id", F.lit(0).alias("block"), "segment_idx", "start_s", "samples",
                            F.lit(None).cast(_MEMORY).alias("entry"))
        return plain.mapInPandas(job.transcripts, schema)

    blocked = rows.withColumn("block", F.floor(F.col("segment_idx") / block_segments))
    out = T.StructType([
        schema.fields[0], T.StructField("block", T.LongType()), *schema.fields[1:],
        T.StructField("exit", T.ArrayType(T.StringType())),
    ])

    def run(todo: DataFrame) -> DataFrame:
        placed = todo.repartition("stream_id", "block").sortWithinPartitions("stream_id", "block", "segment_idx")
        return materialize(
            placed.select("stream_id", "block", "segment_idx", "start_s", "samples", "entry")
            .mapInPandas(job.with_exits, out)
        )

    key = ["stream_id", "block"]
    order = Window.partitionBy("stream_id").orderBy("block")
    blank = F.array(F.lit(""), F.lit(""), F.lit(""))
    results = run(blocked.withColumn("entry", F.lit(None).cast(_MEMORY)))
    used = blocked.select(*key).distinct().withColumn("_used", blank)
    while True:
        wanted = results.filter("exit is not null").select(
            *key, F.coalesce(F.lag("exit").over(order), blank).alias("entry")
        )
        state = materialize(wanted.join(used, key))
        stale = state.filter("entry != _used").select(*key, "entry")
        if stale.isEmpty():
            return results.filter("exit is null").select(*schema.fieldNames())
        again = run(blocked.join(stale, key))
        results = materialize(results.join(stale, key, "left_anti").unionByName(again))
        used = state.select(*key, F.col("entry").alias("_used"))


def timed(chunks: list[tuple[dict, bool]], start: float, length: float, sub_timestamps: bool):
    """(chunk_idx, text, start_s, end_s, prompt_retry) of the chunks of a segment.

    Without a start there are no times: such rows are data, and a log leaves them out.
    """
    for k, (c, retried) in enumerate(chunks):
        t0 = c["t0"] if sub_timestamps else 0.0
        t1 = c["t1"] if sub_timestamps and c["t1"] is not None else length
        begin, end = (None, None) if t0 is None else (start + t0, start + t1)
        yield k, c["text"], begin, end, retried


#: What a recognizer is built for, and how its texts are treated: fields of the struct ``job`` of ``transcribe_jobs``.
MODEL_FIELDS = ("backend", "resolved_model", "language_param", "prompt", "device")
JOB_FIELDS = (*MODEL_FIELDS, "condition", "sub_timestamps", "raw_memory", "strip_spaces", "script")

_CJK_SPACE = re.compile(f"(?<={CJK_WIDE_CLASS}){WHITESPACE_CLASS}+(?={CJK_WIDE_CLASS})")


def dealt(segments: DataFrame) -> DataFrame:
    """Rows with a struct ``job`` in walking order: a conditioned stream is one sequence, other segments are spread."""
    alone = F.when(~F.col("job.condition"), F.col("segment_idx"))
    return segments.repartition("stream_id", alone).sortWithinPartitions("stream_id", "segment_idx")


def transcribe_jobs(
    segments: DataFrame, recognizer: Callable[[dict], Recognizer], rate: int = RATE,
    scripts: dict[str, tuple[str, str]] | None = None,
) -> DataFrame:
    """Transcript rows of ``stream_id, segment_idx, start_s, samples, job``, in the order that ``dealt`` gives.

    Each row's ``job`` (JOB_FIELDS) says how it is recognized, so streams of different families are one pass.
    ``recognizer`` gets the model fields of a job as a dict and builds its recognizing function, once per task and model.
    ``scripts`` maps a job's ``script`` to the characters to replace and their replacements.
    """
    schema = T.StructType([segments.schema["stream_id"], *TRANSCRIPTS.fields[1:]])

    def run(batches):
        built, tables, current, memory = {}, {}, None, Conversation()
        for name, (source, target) in (scripts or {}).items():
            tables[name] = str.maketrans(source, target)
        for pdf in batches:
            rows = []
            for stream, segment, start, samples, job in pdf.itertuples(index=False, name=None):
                model = tuple(job[f] for f in MODEL_FIELDS)
                if model not in built:
                    built[model] = recognizer(dict(zip(MODEL_FIELDS, model, strict=True)))
                fn = built[model]
                if job["strip_spaces"]:
                    fn = _stripped(fn)
                if stream != current or not job["condition"]:
                    current, memory = stream, Conversation()
                table = tables.get(job["script"])
                audio = np.asarray(samples, dtype=np.float32)
                chunks = recognize_one(
                    fn, audio, memory, job["sub_timestamps"], None if table is None else lambda text, t=table: text.translate(t),
                    job["condition"], job["raw_memory"], rate)
                rows += [(stream, segment, *r) for r in timed(chunks, start, len(audio) / rate, job["sub_timestamps"])]
            yield pd.DataFrame(rows, columns=TRANSCRIPTS.fieldNames())

    return segments.select("stream_id", "segment_idx", "start_s", "samples", "job").mapInPandas(run, schema)


def _stripped(fn: Recognizer) -> Recognizer:
    """The function with texts that have no spaces between wide characters."""
    return lambda samples, prompt: [{**c, "text": _CJK_SPACE.sub("", c["text"])} for c in fn(samples, prompt)]


class _Job:
    """One pass over sorted rows, for one task."""

    def __init__(self, recognizer, condition, sub_timestamps, convert, prior_text):
        self.recognizer, self.condition, self.sub_timestamps = recognizer, condition, sub_timestamps
        self.convert, self.raw_memory = convert, prior_text == "raw"

    def transcripts(self, batches):
        for rows, _ in self._walk(batches):
            yield pd.DataFrame([r[:1] + r[2:] for r in rows], columns=TRANSCRIPTS.fieldNames())

    def with_exits(self, batches):
        names = ["stream_id", "block", *TRANSCRIPTS.fieldNames()[1:], "exit"]
        for rows, exits in self._walk(batches):
            data = [(*r, None) for r in rows] + [(s, b, *[None] * 6, memory) for s, b, memory in exits]
            frame = pd.DataFrame(data, columns=names)
            yield frame.astype({"segment_idx": "Int64", "chunk_idx": "Int32", "prompt_retry": "boolean"})

    def _walk(self, batches):
        """Per batch: transcript rows, and the memory of each block that ended."""
        fn, current, memory = self.recognizer(), None, Conversation()
        for pdf in batches:
            rows, exits = [], []
            for stream, block, segment, start, samples, entry in pdf.itertuples(index=False, name=None):
                if not self.condition or (stream, block) != current:
                    if current is not None:
                        exits.append((*current, memory.lines()))
                    current = (stream, block)
                    memory = Conversation(*(entry if entry is not None else ()))
                audio = np.asarray(samples, dtype=np.float32)
                chunks = recognize_one(
                    fn, audio, memory, self.sub_timestamps, self.convert, self.condition, self.raw_memory)
                rows += [(stream, block, segment, *r) for r in timed(chunks, start, len(audio) / RATE, self.sub_timestamps)]
            yield rows, exits
        if current is not None:
            yield [], [(*current, memory.lines())]
