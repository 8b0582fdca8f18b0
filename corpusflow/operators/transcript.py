"""Turns of speech: speakers, merging, pauses, repetitions, and clustering of voices."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Gap within a turn and a turn's length at most, pauses, runs that collapse (seconds, seconds, seconds, segments).
TURN_GAP, TURN_LENGTH, PAUSE, RUN = 10.0, 300.0, 5, 4
#: Likeness of voices of one speaker, and segments that make a cluster stand.
VOICE, SMALL = 0.4, 5
#: Tasks that recordings are dealt to at least, so that few share one.
RECORDING_TASKS = 256


def speakers(segments: DataFrame, voices: DataFrame, bucket: float = 60.0) -> DataFrame:
    """segments (rec, seq, start_s, end_s) with the speaker whose voice segment (seq, start_s, end_s, speaker) holds their middle, else the nearest one's.

    Middles meet voice segments in buckets of time; the segments that none holds look at the last voice before
    and the first after them, which two windows give.
    """
    mid = (F.col("start_s") + F.col("end_s")) / 2
    asked = segments.withColumn("mid", mid)
    spans = voices.select("rec", F.col("seq").alias("vseq"), F.col("start_s").alias("vs"), F.col("end_s").alias("ve"), "speaker")
    cut = spans.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("vs") / bucket), F.floor(F.col("ve") / bucket))))
    inside = asked.withColumn("bucket", F.floor(F.col("mid") / bucket)).join(cut, ["rec", "bucket"]).where(F.col("mid").between(F.col("vs"), F.col("ve")))
    held = inside.groupBy("rec", "seq").agg(F.min_by("speaker", "vseq").alias("speaker"))
    rest = asked.join(held, ["rec", "seq"], "left_anti")
    events = spans.select("rec", F.col("ve").alias("at"), F.lit(0).alias("kind"), F.struct(F.col("ve"), (-F.col("vseq")).alias("o"), "speaker").alias("v"), F.lit(None).cast("long").alias("seq"))
    events = events.unionByName(spans.select("rec", F.col("vs").alias("at"), F.lit(2).alias("kind"), F.struct(F.col("vs").alias("ve"), (-F.col("vseq")).alias("o"), "speaker").alias("v"), F.lit(None).cast("long").alias("seq")))
    asks = rest.select("rec", F.col("mid").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast(events.schema["v"].dataType).alias("v"), F.col("seq").cast("long").alias("seq"))
    line = events.unionByName(asks)
    past = Window.partitionBy("rec").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy("rec").orderBy(F.desc("at"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, 0)
    seen = line.withColumn("last", F.max(F.when(F.col("kind") == 0, F.col("v"))).over(past)).withColumn("next", F.min(F.when(F.col("kind") == 2, F.struct(F.col("v.ve"), (-F.col("v.o")).alias("o"), F.col("v.speaker")))).over(ahead)).where("kind = 1")
    back, on = F.col("at") - F.col("last.ve"), F.col("next.ve") - F.col("at")
    closer = F.when(F.col("next").isNull() | (back < on) | ((back == on) & (-F.col("last.o") < F.col("next.o"))), F.col("last.speaker")).otherwise(F.col("next.speaker"))
    near = seen.select("rec", "seq", F.when(F.col("last").isNull(), F.col("next.speaker")).otherwise(closer).alias("speaker"))
    found = held.unionByName(near)
    return segments.join(found, ["rec", "seq"], "left").withColumn("speaker", F.coalesce("speaker", F.format_string("speaker_unknown_%04d", F.col("seq").cast("int"))))


def merge_turns(segments: DataFrame, gap: float = TURN_GAP, length: float = TURN_LENGTH) -> DataFrame:
    """rec, turn, speaker, start_s, end_s, text: segments of one speaker with small gaps, up to a length, in whole seconds.

    The length counts from where a turn starts, so a turn's end depends on all before it: recordings are folded in order, segment
    by segment, and a task holds no more than the turn that is open. Segments without text are passed over.
    """
    kind = segments.schema["rec"].dataType.simpleString()
    names = ["rec", "turn", "speaker", "start_s", "end_s", "text"]

    def fold(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list | None = None  # recording, turn, speaker, start, end, texts
        rec_type = None

        def made(rows: list[tuple]) -> pa.RecordBatch:
            types = [rec_type, pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        def closed(turn: list) -> tuple:
            return (*turn[:5], " ".join(turn[5]))

        for batch in batches:
            rec_type, out = batch.column(0).type, []
            for rec, speaker, start, end, text in zip(*[batch.column(i).to_pylist() for i in range(5)], strict=True):
                if not (text := (text or "").strip()):
                    continue
                end = max(end, start)
                if held and held[0] == rec and held[2] == speaker and start - held[4] < gap and end - held[3] < length:
                    held[4] = int(end)
                    held[5].append(text)
                    continue
                if held:
                    out.append(closed(held))
                held = [rec, held[1] + 1 if held and held[0] == rec else 0, speaker, int(start), int(end), [text]]
            if out:
                yield made(out)
        if held:
            yield made([closed(held)])

    rows = segments.select("rec", "seq", "speaker", F.col("start_s").cast("double"), F.col("end_s").cast("double"), "text")
    ordered = rows.repartition("rec").sortWithinPartitions("rec", "seq").drop("seq")
    return ordered.mapInArrow(fold, f"rec {kind}, turn int, speaker string, start_s int, end_s int, text string")


def pauses(turns: DataFrame, least: int = PAUSE) -> DataFrame:
    """rec, turn, pause_s before turns (rec, turn, start_s, end_s) that start that long after the one before ends."""
    last = F.lag("end_s").over(Window.partitionBy("rec").orderBy("turn"))
    return turns.withColumn("pause_s", F.col("start_s") - last).where(F.col("pause_s") >= least).select("rec", "turn", "pause_s")


def collapse_runs(segments: DataFrame, least: int = RUN) -> DataFrame:
    """segments (rec, seq, text) without the repetitions in runs of at least ``least`` equal texts."""
    by = Window.partitionBy("rec").orderBy("seq")
    said = F.trim("text")
    island = F.row_number().over(by) - F.row_number().over(Window.partitionBy("rec", said).orderBy("seq"))
    run = Window.partitionBy("rec", said, "_island")
    marked = segments.withColumn("_island", island).withColumn("_n", F.count("*").over(run)).withColumn("_i", F.row_number().over(run.orderBy("seq")))
    return marked.where((F.col("_n") < least) | (F.col("_i") == 1)).select(*segments.columns)


def _repeats(raw: bytes, width: int) -> bool:
    n = len(raw)
    if n < 2 * width:
        return False
    codes = np.frombuffer(raw, np.uint8).astype(np.uint64)
    odd, back = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
    up, down = (np.cumprod(np.concatenate([[1], np.full(n - 1, x, np.uint64)]).astype(np.uint64)) for x in (odd, back))
    sums = np.concatenate([[0], np.cumsum((codes + np.uint64(1)) * up)]).astype(np.uint64)
    hashes = (sums[width:] - sums[:-width]) * down[: n - width + 1]
    order = np.argsort(hashes, kind="stable")
    same = np.flatnonzero(hashes[order][1:] == hashes[order][:-1])
    if len(same) == 0:
        return False
    seen: set[bytes] = set()
    for i in np.unique(np.concatenate([order[same], order[same + 1]])).tolist():  # hashes can be equal by chance
        window = raw[i : i + width]
        if window in seen:
            return True
        seen.add(window)
    return False


def repeats_itself(text: Column, width: int = 60) -> Column:
    """Whether some stretch of that many bytes stands twice in a text of twice as many at least; stretches may overlap. Null texts don't."""

    @F.pandas_udf("boolean")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: t is not None and _repeats(t.encode(), width))

    return run(text)


def round_robin(quotes: DataFrame, limit: int = 20) -> DataFrame:
    """quotes (source_id, pos, quote) in turn from each source, up to a limit."""
    n = F.row_number().over(Window.partitionBy("source_id").orderBy("pos"))
    return quotes.withColumn("round", n).where(F.col("round") <= limit).orderBy("round", "source_id").limit(limit)


def last_turns(turns: DataFrame, n: int) -> DataFrame:
    """The last n turns (conv_id, turn) of each conversation."""
    back = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    return turns.withColumn("_back", back).where(F.col("_back") <= n).drop("_back")


def page(rows: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """One page (from 0) of ordered rows."""
    return rows.orderBy(*order).offset(number * size).limit(size)


def _cosines(centres: np.ndarray, norms: np.ndarray, v: np.ndarray) -> np.ndarray:
    norms = norms * np.linalg.norm(v)
    return np.divide(centres @ v, norms, out=np.zeros(len(centres)), where=norms > 1e-12)


class Voices:
    """The clusters of a recording: vectors come in order and aren't kept, only centres and each vector's number are."""

    def __init__(self, likeness: float = VOICE, small: int = SMALL):
        self.likeness, self.small, self.n = likeness, small, 0
        self.centres, self.norms, self.counts = np.empty((0, 0)), np.empty(0), np.empty(0, np.int64)
        self.of: list[np.ndarray] = []

    def add(self, vectors: np.ndarray) -> None:
        """Each vector to the likeliest centre so far, or to a new one."""
        of = np.empty(len(vectors), np.int64)
        for at, v in enumerate(vectors.astype(np.float64)):
            sims = _cosines(self.centres[: self.n], self.norms[: self.n], v) if self.n else np.empty(0)
            if len(sims) and sims.max() > self.likeness:
                i = int(sims.argmax())
                self.centres[i] = (self.centres[i] * self.counts[i] + v) / (self.counts[i] + 1)
                self.counts[i] += 1
            else:
                i = self.n
                if i == len(self.centres):
                    more = max(64, i)
                    self.centres = np.concatenate([self.centres.reshape(i, len(v)), np.zeros((more, len(v)))])
                    self.norms, self.counts = (np.concatenate([x, np.zeros(more, x.dtype)]) for x in (self.norms, self.counts))
                self.centres[i], self.counts[i] = v, 1
                self.n += 1
            self.norms[i] = np.linalg.norm(self.centres[i : i + 1], axis=-1)[0]
            of[at] = i
        self.of.append(of)

    def _merge(self) -> tuple[np.ndarray, np.ndarray]:
        """The likest centres merge, again and again: each centre's target, and which stay.

        Every centre knows the likest of those after it. Where that one has changed or gone, what it had is a bound, and it is
        looked up anew when the bound is the largest of all.
        """
        n, c, norms, counts = self.n, self.centres[: self.n], self.norms[: self.n], self.counts[: self.n]
        alive, target, places = np.ones(n, bool), np.arange(n), np.arange(n)
        best, to, stale = np.full(n, np.inf), np.zeros(n, np.int64), np.ones(n, bool)

        def likest(a: int, b: int) -> None:
            sims = (c[a:b] @ c[a:].T) / np.maximum(np.outer(norms[a:b], norms[a:]), 1e-12)
            sims[~alive[a:] | (places[a:] <= places[a:b, None])] = -np.inf
            to[a:b] = a + sims.argmax(1)
            best[a:b] = sims[np.arange(b - a), to[a:b] - a]
            stale[a:b] = False

        for a in range(0, n, 256):
            likest(a, min(n, a + 256))
        while n:
            i = int(best.argmax())
            if best[i] <= self.likeness:
                break
            if stale[i]:
                likest(i, i + 1)
                continue
            j = int(to[i])
            c[i] = (c[i] * counts[i] + c[j] * counts[j]) / (counts[i] + counts[j])
            norms[i] = np.linalg.norm(c[i : i + 1], axis=-1)[0]
            counts[i] += counts[j]
            counts[j], alive[j], best[j], target[j] = 0, False, -np.inf, i
            stale |= alive & (to == j)
            likest(i, i + 1)
            before = alive[:i]
            sims = (c[:i] @ c[i]) / np.maximum(norms[:i] * norms[i], 1e-12)
            stale[:i] |= before & (to[:i] == i) & (sims < best[:i])
            closer = before & ((sims > best[:i]) | ((sims == best[:i]) & ~stale[:i] & (i <= to[:i])))
            best[:i][closer], to[:i][closer], stale[:i][closer] = sims[closer], i, False
        for i in range(n):  # a target comes before what it took
            target[i] = target[target[i]]
        return target, alive

    def clusters(self) -> np.ndarray:
        """A cluster for each vector: centres merge, then small clusters join the nearest large one."""
        target, alive = self._merge()
        counts = self.counts[: self.n]
        large = np.flatnonzero(alive & (counts >= self.small))
        if len(large):
            c, norms = self.centres[large], self.norms[large]
            move = np.arange(self.n)
            for i in np.flatnonzero(alive & (counts < self.small)):
                move[i] = large[_cosines(c, norms, self.centres[i]).argmax()]
            target = move[target]
        return target[np.concatenate([np.empty(0, np.int64), *self.of])]


def cluster(vectors: np.ndarray, likeness: float = VOICE, small: int = SMALL) -> np.ndarray:
    """A cluster for each vector of a recording, in order: to the likeliest centre or a new one; then the likest centres merge; then small clusters join the nearest large one.

    A merged cluster counts its members once.
    """
    voices = Voices(likeness, small)
    voices.add(vectors)
    return voices.clusters()


def cluster_voices(segments: DataFrame, likeness: float = VOICE, small: int = SMALL) -> DataFrame:
    """rec, seq, cluster of segments (rec, seq, embedding); recordings are independent.

    A vector's centre depends on all vectors before it, so a recording is folded in order; recordings are dealt to many
    tasks, and a task holds the centres and numbers of the one that is open.
    """
    kind = segments.schema["rec"].dataType.simpleString()
    names = ["rec", "seq", "cluster"]

    def fold(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voices, rec, seqs = Voices(likeness, small), None, []

        def closed() -> Iterator[pa.RecordBatch]:
            found, at = pa.array(voices.clusters()), 0
            for seq in seqs:
                yield pa.RecordBatch.from_arrays([pa.array([rec.as_py()] * len(seq), rec.type), seq, found.slice(at, len(seq))], names)
                at += len(seq)

        for batch in batches:
            ends = [*pc.run_end_encode(batch.column(0)).run_ends.to_pylist()]
            for a, b in zip([0, *ends], ends, strict=False):
                part = batch.slice(a, b - a)
                if rec is not None and part.column(0)[0] != rec:
                    yield from closed()
                    voices, seqs = Voices(likeness, small), []
                rec = part.column(0)[0]
                seqs.append(part.column(1))
                voices.add(part.column(2).flatten().to_numpy(zero_copy_only=False).reshape(b - a, -1))
        if seqs:
            yield from closed()

    rows = segments.select("rec", F.col("seq").cast("long").alias("seq"), "embedding")
    tasks = max(RECORDING_TASKS, int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = rows.repartition(tasks, "rec").sortWithinPartitions("rec", F.asc_nulls_last("seq"))
    return ordered.mapInArrow(fold, f"rec {kind}, seq long, cluster long")


def render(turns: DataFrame, least_pause: int = PAUSE) -> DataFrame:
    """rec and the whole transcript as text: a heading with a clock for each turn, and a note where there was a pause."""
    from corpusflow.functions.text import clock

    last = F.lag("end_s").over(Window.partitionBy("rec").orderBy("turn"))
    gap = F.col("start_s") - last
    note = F.when(gap >= least_pause, F.format_string("> [pause: %ds]\n\n", gap)).otherwise("")
    head = F.concat(F.lit("## @"), "speaker", F.lit(" ["), clock(F.col("start_s")), F.lit(" → "), clock(F.col("end_s")), F.lit("]\n\n"))
    block = turns.select("rec", "turn", F.concat(note, head, "text").alias("block"))
    return block.groupBy("rec").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "block"))), lambda x: x["block"]), "\n\n").alias("body"))
