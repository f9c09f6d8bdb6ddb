"""State that runs along frames or events: as a stream's keyed state, and as windows over a table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from framelake.functions.groups import Arrays, per_group
from framelake.operators.numbering import numbered

# How long an object is on probation, and after how many frames it goes.
DELAY, UNMATCHED, DUPLICATE = 15, 8, 8
KEEP_ALIVE, KEEP_MIN, KEEP_MAX = 0, -4, 8
SMOOTHING = 0.2
#: Later than any frame.
REMOVED = 100000
# Tries of a queued item, and seconds before the next.
ATTEMPTS, RETRY_DELAY = 3, 1.0
#: Times of a log that are summed together.
STRETCH = 100000

STATE = "first map<int,int>, missed map<int,int>, alive map<int,int>, pairs map<string,int>, removed array<int>"
EVENTS = "video_id int, frame int, object_id int, event string, keep_alive int"


class Probation:
    """Objects of one video. A frame's rows tell which objects are new, matched (and to which detection), unmatched, or empty.

    reverse: frames come from the last to the first. empties: an empty mask counts against an object as a missing match does."""

    def __init__(self, state=None, delay: int = DELAY, unmatched: int = UNMATCHED, duplicate: int = DUPLICATE, reverse: bool = False, empties: bool = False):
        self.first, self.missed, self.alive, self.pairs, self.removed = {}, {}, {}, {}, set()
        if state is not None:
            self.first, self.missed, self.alive, self.pairs = (dict(x) for x in state[:4])
            self.removed = set(state[4])
        self.delay, self.unmatched, self.duplicate, self.sign, self.empties = delay, unmatched, duplicate, -1 if reverse else 1, empties

    def state(self) -> tuple:
        return self.first, self.missed, self.alive, self.pairs, sorted(self.removed)

    def step(self, frame: int, rows: list[tuple[int, str, int | None]]) -> list[tuple[int, str, int]]:
        """Events (object, removed or suppressed, keep-alive) of a frame with rows (object, status, detection)."""
        turn = self.sign * frame
        groups: dict[int, set[int]] = {}
        for o, status in sorted({(o, status) for o, status, _ in rows}):
            self.first.setdefault(o, turn)
            self.alive.setdefault(o, KEEP_ALIVE)
            if status == "matched":
                self.alive[o] = min(KEEP_MAX, self.alive[o] + 1)
            elif status == "unmatched" or status == "empty" and self.empties:
                self.missed[o] = self.missed.get(o, 0) + (status == "unmatched")
                self.alive[o] = max(KEEP_MIN, self.alive[o] - 1)
        for o, status, detection in rows:
            if status == "matched":
                groups.setdefault(detection, set()).add(o)
        gone, out, young = set(), [], turn - self.delay
        for o, n in self.missed.items():
            if o in self.removed or n == 0:
                continue
            if n >= self.unmatched and self.first[o] > young:
                gone.add(o)
            elif self.alive[o] <= 0:
                out.append((o, "suppressed", self.alive[o]))
        for objects in groups.values():
            oldest = min(objects, key=lambda o: (self.first[o], o))
            for o in objects - {oldest}:
                self.pairs[f"{oldest}:{o}"] = self.pairs.get(f"{oldest}:{o}", 0) + 1
        for pair, n in self.pairs.items():
            o = int(pair.split(":")[1])
            if n >= self.duplicate and o not in self.removed and self.first[o] > young:
                gone.add(o)
        self.removed |= gone
        return sorted([x for x in out if x[0] not in gone] + [(o, "removed", self.alive[o]) for o in gone])


def probation_stream(rows: DataFrame, reverse: bool = False, empties: bool = False) -> DataFrame:
    """Events of a stream of (video_id, frame, object_id, status, detection); a video's frames must come in order, or from the last to the first."""

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        p, out = Probation(state.get if state.exists else None, reverse=reverse, empties=empties), []
        pdf = pd.concat(list(batches))
        for frame, g in sorted(pdf.groupby("frame"), reverse=reverse):
            r = [(int(o), s, None if pd.isna(x) else int(x)) for o, s, x in zip(g["object_id"], g["status"], g["detection"], strict=True)]
            out += [(key[0], int(frame), *e) for e in p.step(int(frame), r)]
        state.update(p.state())
        yield pd.DataFrame(out, columns=["video_id", "frame", "object_id", "event", "keep_alive"])

    return rows.groupBy("video_id").applyInPandasWithState(run, EVENTS, STATE, "append", "NoTimeout")


def keep_alive(steps: DataFrame) -> DataFrame:
    """Of steps (video_id, object_id, turn, rank, up) the count after each frame: up or down by one a step, within its limits. A group is one object's steps."""

    def run(a: Arrays) -> Arrays:
        n, out = KEEP_ALIVE, []
        for up in a["up"].tolist():
            n = min(KEEP_MAX, max(KEEP_MIN, n + up)) if up else n
            out.append(n)
        last = np.append(a["turn"][1:] != a["turn"][:-1], True)
        return {c: a[c][last] for c in ("video_id", "object_id", "turn")} | {"alive": np.array(out)[last]}

    return per_group(steps, ["video_id", "object_id"], ["turn", "rank"], "video_id int, object_id int, turn int, alive int", run)


def probation_table(rows: DataFrame, reverse: bool = False, empties: bool = False, delay: int = DELAY, unmatched: int = UNMATCHED, duplicate: int = DUPLICATE) -> DataFrame:
    """The same events for a whole table, as windows and joins: a task holds an object's steps, not a video.

    An object goes at the frame of its unmatched-th miss, or of its duplicate-th shared detection with one older object, if it
    is young then; it is suppressed at every frame after its first miss where its count is down to nothing, until it goes."""
    rows = rows.withColumn("turn", F.col("frame") * (-1 if reverse else 1))
    states = rows.select("video_id", "object_id", "turn", "status").distinct()
    first = states.groupBy("video_id", "object_id").agg(F.min("turn").alias("first"))
    counts = Window.partitionBy("video_id", "object_id", "status").orderBy("turn")
    missed = states.filter("status = 'unmatched'").withColumn("n", F.row_number().over(counts))
    young = F.col("turn") - delay < F.col("first")
    gone = missed.filter(F.col("n") == unmatched).join(first, ["video_id", "object_id"]).filter(young)
    shared = rows.filter("status = 'matched'").select("video_id", "turn", "detection", "object_id").distinct().join(first, ["video_id", "object_id"])
    of = Window.partitionBy("video_id", "turn", "detection")
    shared = shared.withColumn("oldest", F.min(F.struct("first", "object_id")).over(of)["object_id"]).filter("oldest <> object_id")
    pair = Window.partitionBy("video_id", "oldest", "object_id").orderBy("turn", "detection")
    copies = shared.withColumn("n", F.row_number().over(pair)).groupBy("video_id", "turn", "oldest", "object_id", "first").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    copies = copies.filter((F.col("low") <= duplicate) & (F.col("high") >= duplicate) & young)
    gone = gone.select("video_id", "object_id", "turn").unionByName(copies.select("video_id", "object_id", "turn")).groupBy("video_id", "object_id").agg(F.min("turn").alias("gone"))
    down = F.col("status").isin("unmatched", "empty") if empties else F.col("status") == "unmatched"
    steps = states.select("video_id", "object_id", "turn", F.when(F.col("status") == "matched", 1).when(down, -1).otherwise(0).alias("up"), F.col("status").alias("rank"))
    frames = rows.select("video_id", "turn").distinct()
    last = frames.groupBy("video_id").agg(F.max("turn").alias("last"))
    # A count holds until the next frame with a step.
    spans = keep_alive(steps).withColumn("next", F.lead("turn").over(Window.partitionBy("video_id", "object_id").orderBy("turn")))
    since = missed.filter("n = 1").select("video_id", "object_id", F.col("turn").alias("since"))
    held = spans.join(since, ["video_id", "object_id"]).join(last, "video_id").join(gone, ["video_id", "object_id"], "left")
    low, high = F.greatest("turn", "since"), F.least(F.coalesce(F.col("next") - 1, F.col("last")), F.coalesce(F.col("gone") - 1, F.col("last")))
    idle = held.filter((F.col("alive") <= 0) & (low <= high)).select("video_id", "object_id", "alive", F.explode(F.sequence(low, high)).alias("turn"))
    idle = idle.join(frames, ["video_id", "turn"], "left_semi").select("video_id", "turn", "object_id", F.lit("suppressed").alias("event"), "alive")
    ended = gone.join(spans, ["video_id", "object_id"]).filter("gone >= turn and (next is null or gone < next)")
    out = idle.unionByName(ended.select("video_id", F.col("gone").alias("turn"), "object_id", F.lit("removed").alias("event"), "alive"))
    return out.select("video_id", (F.col("turn") * (-1 if reverse else 1)).alias("frame"), "object_id", "event", F.col("alive").alias("keep_alive"))


def last_occluded(rows: DataFrame, keys: list[str], frame: str = "frame", occluded: str = "occluded") -> DataFrame:
    """rows with the last earlier frame at which their object was occluded, -1 for never."""
    w = Window.partitionBy(*keys).orderBy(frame).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("last_occluded", F.coalesce(F.last(F.when(F.col(occluded), F.col(frame)), ignorenulls=True).over(w), F.lit(-1)))


def suppress_recent(pairs: DataFrame, reverse: bool = False) -> DataFrame:
    """frame, suppressed: of overlapping pairs (frame, a, b and their last frames of occlusion, -1 for never) the objects to suppress.

    It is the one that was occluded later (in reverse order earlier), if the other was ever occluded; none if equal. An object
    that was removed counts as occluded at REMOVED."""
    a, b = F.col("a_last"), F.col("b_last")
    first = (a < b) if reverse else (a > b)
    second = (b < a) if reverse else (b > a)
    later = F.when(first & (b > -1), F.col("a")).when(second & (a > -1), F.col("b"))
    return pairs.withColumn("suppressed", later).filter("suppressed is not null").select("frame", "suppressed").distinct()


def smoothed(steps: Column, alpha: float = SMOOTHING) -> Column:
    """The exponential mean of an array of times a step, the first its start; null of none."""
    start = F.lit(None).cast("double")
    return F.aggregate(steps, start, lambda acc, x: F.when(acc.isNull(), x).otherwise(alpha * x + (1 - alpha) * acc))


def remaining(events: DataFrame, key: str, at: str, total: Column) -> DataFrame:
    """key, done, seconds a step (smoothed) and the seconds left, from one event a step."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(at))), lambda x: F.unix_micros(x[at].cast("timestamp")) / 1e6)
    t = events.groupBy(key).agg(ordered.alias("t"), F.count("*").alias("done"))
    gaps = F.zip_with(F.slice("t", 2, F.size("t")), F.slice("t", 1, F.size("t") - 1), lambda b, a: b - a)
    return t.withColumn("step_s", smoothed(F.filter(gaps, lambda x: x > 0))).withColumn("left_s", F.col("step_s") * F.greatest(total - F.col("done"), F.lit(0))).drop("t")


def windows(events: DataFrame, at: str, size: str, keys: list[str], slide: str | None = None, late: str | None = None) -> DataFrame:
    """Counts and sums of `value` by tumbling or sliding window and keys; over a stream, with a watermark."""
    e = events.withColumn(at, F.col(at).cast("timestamp"))
    if late:
        e = e.withWatermark(at, late)
    w = F.window(at, size, slide) if slide else F.window(at, size)
    return e.groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), *keys, "n", "total")


def sessions(events: DataFrame, at: str, gap: str, keys: list[str], late: str | None = None) -> DataFrame:
    """Sessions of a key: spans without a gap."""
    e = events.withColumn(at, F.col(at).cast("timestamp"))
    if late:
        e = e.withWatermark(at, late)
    return e.groupBy(F.session_window(at, gap).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


def queue_status(events: DataFrame, attempts: int = 3) -> DataFrame:
    """Of each queued item the last status, its attempts, and whether it may be tried again."""
    t = events.groupBy("item").agg(F.max_by("status", "at").alias("status"), F.count_if(F.col("status") == "failed").alias("failures"))
    return t.withColumn("retry", (F.col("status") == "failed") & (F.col("failures") < attempts))


def queue_log(events: DataFrame, attempts: int = ATTEMPTS, delay: float = RETRY_DELAY) -> DataFrame:
    """events of queued items (item, at in seconds, event: added, started, progress, failed, completed or cancelled, fraction,
    message) with what an item is after each: status, failures, retry_at, progress, text; and running, the items at work then.

    An item that fails stays at work, waits `delay` seconds and is tried again, `attempts` times in all; then it has failed.
    What comes after an item has ended is ignored, until it is added again."""
    order = Window.partitionBy("item").orderBy("at", "event")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    ends = F.col("event").isin("completed", "cancelled")
    t = events.withColumn("life", F.sum(F.when(F.col("event") == "added", 1).otherwise(0)).over(upto))
    life = Window.partitionBy("item", "life").orderBy("at", "event")
    past, before = life.rowsBetween(Window.unboundedPreceding, 0), life.rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("failures", F.sum(F.when(F.col("event") == "failed", 1).otherwise(0)).over(past))
    over = F.coalesce(F.max(ends | (F.col("failures") >= attempts)).over(before), F.lit(False))
    t = t.withColumn("over", over).filter("not over")
    failed = F.col("event") == "failed"
    status = F.when(failed & (F.col("failures") >= attempts), "failed").when(F.col("event") == "added", "pending").when(ends, F.col("event")).otherwise("processing")
    t = t.withColumn("status", status).withColumn("retry_at", F.when(failed & (F.col("failures") < attempts), F.col("at") + delay))
    own = F.when(failed & (F.col("failures") < attempts), F.concat(F.lit("Retrying... ("), F.col("failures").cast("string"), F.lit(f"/{attempts})"))).when(F.col("event") == "started", F.coalesce("message", F.lit("Starting..."))).otherwise(F.col("message"))
    t = t.withColumn("progress", F.coalesce(F.last("fraction", ignorenulls=True).over(past), F.lit(0.0))).withColumn("text", F.coalesce(F.last(own, ignorenulls=True).over(past), F.lit("Waiting...")))
    # An item that begins or ends its work changes how many are at work from then on.
    work = F.when(F.col("status") == "processing", 1).otherwise(0)
    t = t.withColumn("step", work - F.coalesce(F.lag(work).over(order), F.lit(0)))
    steps = t.groupBy("at").agg(F.sum("step").alias("step"))
    marks = numbered(steps, ["at"], "mark")
    return t.drop("over", "life").join(_running(marks), "at")


def _running(marks: DataFrame) -> DataFrame:
    """at, running: the sum of the steps up to each time. Times are summed a stretch at a time, then the stretches."""
    marks = marks.withColumn("stretch", F.floor(F.col("mark") / STRETCH))
    whole = marks.groupBy("stretch").agg(F.sum("step").alias("all"))
    before = whole.withColumn("before", F.coalesce(F.sum("all").over(Window.orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row a stretch
    inner = F.sum("step").over(Window.partitionBy("stretch").orderBy("mark").rowsBetween(Window.unboundedPreceding, 0))
    return marks.join(before.select("stretch", "before"), "stretch").select("at", (inner + F.col("before")).alias("running"))


def queue_snapshots(log: DataFrame, times: DataFrame, width: float = 60.0) -> DataFrame:
    """snapshot, item, status, progress, text: every item that is queued at each time (snapshot) as it is then; ended items stay until they are added again.

    Spans and snapshots meet in stretches of `width` seconds."""
    at = Window.partitionBy("item").orderBy("at", "event")
    last = times.agg(F.max("snapshot")).first()[0]
    if last is None:
        return log.limit(0).select(F.col("at").alias("snapshot"), "item", "status", "progress", "text")
    spans = log.withColumn("until", F.lead("at").over(at)).filter(F.col("at") <= last)
    to = F.least(F.coalesce("until", F.lit(last)), F.lit(last))
    spans = spans.withColumn("stretch", F.explode(F.sequence(F.floor(F.col("at") / width), F.floor(to / width))))
    times = times.select("snapshot", F.floor(F.col("snapshot") / width).alias("stretch"))
    met = spans.join(times, "stretch").filter((F.col("at") <= F.col("snapshot")) & (F.col("until").isNull() | (F.col("snapshot") < F.col("until"))))
    return met.select("snapshot", "item", "status", "progress", "text")
