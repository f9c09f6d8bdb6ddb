"""Choosing a subject's box: strategies, cascades and crops, as aggregates over candidates.

Candidates are rows (image_id, idx, x1, y1, x2, y2, conf, type). The best of an image is a max_by over a struct,
which Spark aggregates before it shuffles; equal candidates go to the smaller idx.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.functions import boxes as B

# Strategy names, weights and thresholds.
STRATEGIES = ("Largest Subject", "Center-most Subject", "Highest Confidence", "Tallest Subject", "Area x Confidence", "Rule-of-Thirds", "Edge-avoiding", "Balanced", "Best Face")
BALANCED = {"area": 0.4, "confidence": 0.4, "edge": 0.2}
MIN_CONFIDENCE, MIN_IOU, MIN_FACE_SIM = 0.4, 0.5, 0.4
CONTAIN_SCORE, CONFIDENCE_SCORE, IOU_BONUS = 100.0, 20.0, 50.0


def strategy_score(strategy: str, width: float, height: float, box: B.Box | None = None, face_score: Column | None = None) -> Column:
    """A candidate's score; an unknown strategy counts as the first."""
    b, conf = box or B.box(), F.col("conf")
    cx, cy = B.centre(b)
    edge = F.least(b[0], b[1], width - b[2], height - b[3])
    away = lambda x, y: F.hypot(cx - x, cy - y)
    if strategy == "Center-most Subject":
        return -away(width / 2, height / 2)
    if strategy == "Highest Confidence":
        return F.when(conf < MIN_CONFIDENCE, -1.0).otherwise(conf)
    if strategy == "Tallest Subject":
        return b[3] - b[1]
    if strategy == "Area x Confidence":
        return B.area(b) * conf
    if strategy == "Rule-of-Thirds":
        return -F.least(*[away(i * width / 3, j * height / 3) for j in (1, 2) for i in (1, 2)])
    if strategy == "Edge-avoiding":
        return edge
    if strategy == "Balanced":
        return BALANCED["area"] * (B.area(b) / (width * height)) + BALANCED["confidence"] * conf + BALANCED["edge"] * (edge / (min(width, height) / 2))
    if strategy == "Best Face" and face_score is not None:
        return face_score
    return B.area(b)


def _best(candidates: DataFrame, score: Column) -> DataFrame:
    row = F.struct("idx", "x1", "y1", "x2", "y2", "conf", score.alias("score"))
    order = F.struct(score, F.col("conf"), B.area(B.box()), -F.col("idx"))
    return candidates.groupBy("image_id").agg(F.max_by(row, order).alias("best")).select("image_id", "best.*")


def best_subject(candidates: DataFrame, strategy: str, width: float, height: float) -> DataFrame:
    """The best candidate of each image under a strategy: image_id, idx, box, conf, score."""
    return _best(candidates, strategy_score(strategy, width, height))


def best_face_subject(candidates: DataFrame, faces: DataFrame, width: float, height: float, reference_centre: bool = True) -> DataFrame:
    """Under "Best Face": the score is the best det_score among faces (image_id, fx1.., det_score) whose point is in the box.

    reference_centre takes x1 + x2 / 2 for a face's point, as results to match do; without it the point is the centre."""
    half = (lambda a, b: F.col(a) + F.col(b) / 2) if reference_centre else (lambda a, b: (F.col(a) + F.col(b)) / 2)
    points = faces.select("image_id", half("fx1", "fx2").alias("px"), half("fy1", "fy2").alias("py"), "det_score")
    # An image's faces come to its boxes as one row, so boxes are not grouped again.
    points = points.groupBy("image_id").agg(F.collect_list(F.struct("px", "py", "det_score")).alias("__faces"))
    inside = F.transform("__faces", lambda f: F.when(B.holds(B.box(), f["px"], f["py"]), f["det_score"]))
    scored = candidates.join(points, "image_id", "left").withColumn("face_score", F.greatest(F.coalesce(F.array_max(inside), F.lit(0.0)), F.lit(0.0))).drop("__faces")
    return _best(scored, F.col("face_score"))


def similarity_in_box(best: DataFrame, faces: DataFrame) -> DataFrame:
    """best with seed_face_sim, the best similarity of a face whose centre is in the box, edges included; else 0."""
    cx, cy = (F.col("fx1") + F.col("fx2")) / 2, (F.col("fy1") + F.col("fy2")) / 2
    inside = F.when(B.holds(B.box(), cx, cy, closed=True), F.col("sim"))
    return best.join(faces.select("image_id", "fx1", "fy1", "fx2", "fy2", "sim"), "image_id", "left").groupBy(*best.columns).agg(F.greatest(F.coalesce(F.max(inside), F.lit(0.0)), F.lit(0.0)).alias("seed_face_sim"))


def iou_pairs(left: DataFrame, right: DataFrame, eps: float = 1e-6, key: str = "image_id") -> DataFrame:
    """All pairs of an image's boxes with their IoU; boxes are right's with the prefix r_."""
    r = right.select(key, *[F.col(c).alias("r_" + c) for c in ("idx", "x1", "y1", "x2", "y2", "conf")])
    return left.join(r, key).withColumn("iou", B.iou(B.box(), B.box("r_"), eps))


def object_first(candidates: DataFrame, strategy: str, width: float, height: float) -> DataFrame:
    """Of each image a box x, y, w, h and its kind: the text box that a subject box confirms, else the first text box, else the strategy's."""
    text, subject = candidates.filter("type = 'text'"), candidates.filter("type = 'subject'")
    pairs = iou_pairs(text, subject)
    order = F.struct(F.col("iou"), -F.col("idx"), -F.col("r_idx"))
    matched = pairs.groupBy("image_id").agg(F.max_by(F.struct("x1", "y1", "x2", "y2", "iou"), order).alias("match")).filter(F.col("match.iou") > MIN_IOU)
    first = text.groupBy("image_id").agg(F.min_by(F.struct("x1", "y1", "x2", "y2"), "idx").alias("first"))
    other = best_subject(subject, strategy, width, height).select("image_id", F.struct("x1", "y1", "x2", "y2").alias("other"))
    all_ = candidates.select("image_id").distinct().join(matched, "image_id", "left").join(first, "image_id", "left").join(other, "image_id", "left")
    chosen = F.coalesce(F.when(F.col("match").isNotNull(), F.struct(*[F.col("match")[c].alias(c) for c in ("x1", "y1", "x2", "y2")])), F.col("first"), F.col("other"))
    kind = F.when(F.col("match").isNotNull(), "text_and_subject").when(F.col("first").isNotNull(), "text").otherwise("strategy")
    x, y, w, h = B.whole_xywh(B.field("chosen"), width, height)
    return all_.withColumn("chosen", chosen).select("image_id", x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"), kind.alias("kind"))


def evidence(candidates: DataFrame, targets: DataFrame, width: float, height: float) -> DataFrame:
    """Identity first: of each target face (image_id, fx1.., sim) above the least similarity the candidate with the most evidence.

    100 for containing the face, 20 times the confidence, 50 where the candidate is in the image's best pair of a
    subject and a text box with enough overlap; without candidates the box that the face suggests."""
    faces = targets.filter(F.col("sim") > MIN_FACE_SIM).groupBy("image_id").agg(F.max_by(F.struct("fx1", "fy1", "fx2", "fy2", "sim"), "sim").alias("face"))
    pairs = iou_pairs(candidates.filter("type = 'subject'"), candidates.filter("type = 'text'"))
    pair = pairs.groupBy("image_id").agg(F.max_by(F.struct("idx", "r_idx", "iou"), F.struct(F.col("iou"), -F.col("idx"), -F.col("r_idx"))).alias("pair")).filter(F.col("pair.iou") > MIN_IOU)
    face = tuple(F.col("face")[c] for c in ("fx1", "fy1", "fx2", "fy2"))
    rows = candidates.join(faces, "image_id").join(pair, "image_id", "left")
    bonus = F.coalesce((F.col("idx") == F.col("pair.idx")) | (F.col("idx") == F.col("pair.r_idx")), F.lit(False))
    score = F.when(B.contains(B.box(), face), CONTAIN_SCORE).otherwise(0.0) + CONFIDENCE_SCORE * F.col("conf") + F.when(bonus, IOU_BONUS).otherwise(0.0)
    subject_first = F.when(F.col("type") == "subject", 0).otherwise(1)
    best = rows.groupBy("image_id").agg(F.max_by(F.struct("x1", "y1", "x2", "y2", score.alias("score")), F.struct(score, -subject_first, -F.col("idx"))).alias("best"))
    out = faces.join(best, "image_id", "left")
    own, grown = B.whole_xywh(B.field("best"), width, height), B.body(face, width, height)
    some = F.col("best").isNotNull()
    return out.select("image_id", *[F.when(some, o).otherwise(g).alias(c) for c, o, g in zip("xywh", own, grown, strict=True)], F.when(some, "evidence").otherwise("face").alias("kind"), F.col("best.score").alias("score"))


def cascade(images: DataFrame, sources: list[tuple[str, DataFrame]]) -> DataFrame:
    """Of each image the box (a struct) of the first source that has one, and that source's name."""
    out = images.select("image_id").distinct()
    for name, s in sources:
        out = out.join(s.select("image_id", F.col("box").alias(f"box_{name}")), "image_id", "left")
    names = [n for n, _ in sources]
    source = reduce(lambda c, n: c.when(F.col(f"box_{n}").isNotNull(), n), names[1:], F.when(F.col(f"box_{names[0]}").isNotNull(), names[0]))
    return out.select("image_id", F.coalesce(*[F.col(f"box_{n}") for n in names]).alias("box"), source.alias("source"))


def aspect_ratios(text: str) -> list[tuple[str, float]]:
    """Pairs of name and ratio from a list such as "16:9, 1:1"; what is no ratio is left out."""
    out = []
    for part in text.replace(";", ",").split(","):
        a, colon, b = part.strip().partition(":")
        try:
            if colon and float(a) > 0 and float(b) > 0:
                out.append((part.strip(), float(a) / float(b)))
        except ValueError:
            continue
    return out


def crop_plan(subjects: DataFrame, ratios: list[tuple[str, float]], padding: float = 1.0) -> DataFrame:
    """The best crop for each subject (frame_w, frame_h, x, y, w, h): smallest area, then the ratio nearest the subject's.

    Crops that can't hold the subject drop out; a subject without any, or of no size, gives no row."""
    x, y, w, h, fw, fh = (F.col(c).cast("double") for c in ("x", "y", "w", "h", "frame_w", "frame_h"))
    # A crop keeps its ratio, so each side alone says how large it is: as small as holds the subject, padded, but
    # no larger than the frame, and the frame's largest where the subject does not fit.
    grown = lambda least, most: F.least(F.greatest(F.least(least * padding, most), least), most)
    rs = [F.lit(float(r)) for _, r in ratios]
    t = subjects.filter("w > 0 and h > 0")
    # A subject's crops stand side by side in its row: nothing is repeated, grouped or shuffled.
    t = t.withColumns({f"__g{c}{i}": v for i, r in enumerate(rs) for c, v in (("w", grown(F.greatest(w, h * r), F.least(fw, fh * r))), ("h", grown(F.greatest(h, w / r), F.least(fh, fw / r))))})
    size = [(F.col(f"__gw{i}"), F.col(f"__gh{i}")) for i in range(len(rs))]
    t = t.withColumns({f"__c{c}{i}": F.greatest(F.lit(0.0), F.least(at + own / 2 - g / 2, frame - g)) for i, (gw, gh) in enumerate(size) for c, at, own, g, frame in (("x", x, w, gw, fw), ("y", y, h, gh, fh))})
    crops = []
    for i, ((name, _), (gw, gh)) in enumerate(zip(ratios, size, strict=True)):
        cx, cy = F.col(f"__cx{i}"), F.col(f"__cy{i}")
        whole = [cx.cast("int").alias("crop_x"), cy.cast("int").alias("crop_y"), gw.cast("int").alias("crop_w"), gh.cast("int").alias("crop_h")]
        order = [(gw * gh).alias("__area"), F.abs(F.try_divide(gw.cast("int"), gh.cast("int")) - w / h).alias("__off"), F.lit(i).alias("__i")]
        crops.append(F.when((cx <= x) & (cy <= y) & (cx + gw >= x + w) & (cy + gh >= y + h), F.struct(*order, F.lit(name).alias("ratio"), *whole)))
    # A generator, not a filter: a filter would be moved below and compute all crops a second time.
    return t.select(*subjects.columns, F.inline(F.array_compact(F.array(F.array_min(F.array(*crops)))))).drop("__area", "__off", "__i")
