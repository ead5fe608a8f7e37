"""Points and images: visibility, pixel lookups, routing by class, boxes and class maps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrafold.functions.geometry import iou
from terrafold.session import cut, ship_package

#: Pixels of a tile's side.
TILE = 64
#: Boxes whose tiles are painted together: as many tiles at most, of 32 KB each.
TILES = 1024


def pixel(c: str) -> Column:
    """The pixel whose middle is nearest; halves go up."""
    return F.floor(F.col(c) + 0.5).cast("long")


def project(points: DataFrame, uvgood: tuple[Column, Column, Column], camera: dict, min_depth: float = 0.0, max_depth: float = float("inf")) -> DataFrame:
    """Points with ``u``, ``v``, ``depth`` that fall into the image and the closed depth window."""
    u, v, good = uvgood
    p = points.withColumns({"u": u, "v": v, "depth": F.col("z"), "valid": good}).filter("valid").drop("valid")
    return p.filter((F.col("u") >= 0) & (F.col("u") < camera["width"]) & (F.col("v") >= 0) & (F.col("v") < camera["height"]) & F.col("depth").between(min_depth, max_depth))


def visible(projected: DataFrame, window: int = 1, tolerance: float = 0.15, by: str = "frame") -> DataFrame:
    """Points no deeper than the nearest of the pixels around theirs, and the tolerance."""
    p = projected.withColumns({"pu": pixel("u"), "pv": pixel("v")})
    near = p.groupBy(by, "pu", "pv").agg(F.min("depth").alias("d"))
    steps = F.sequence(F.lit(-window), F.lit(window))
    spread = near.withColumn("du", F.explode(steps)).withColumn("dv", F.explode(steps)).select(by, (F.col("pu") + F.col("du")).alias("pu"), (F.col("pv") + F.col("dv")).alias("pv"), "d")
    least = spread.groupBy(by, "pu", "pv").agg(F.min("d").alias("window_min"))
    return p.join(least, [by, "pu", "pv"]).filter(F.col("depth") <= F.col("window_min") + tolerance)


def pixel_lookup(projected: DataFrame, pixels: DataFrame, by: str = "frame", unknown: int = -1) -> DataFrame:
    """Class and confidence of each point's pixel; unknown, with confidence 0, where the map has none."""
    p = projected.withColumns({"pu": pixel("u"), "pv": pixel("v")})
    q = pixels.select(by, F.col("u").alias("pu"), F.col("v").alias("pv"), F.col("class_id").alias("pixel_class"), F.col("confidence").alias("pixel_confidence"))
    return p.join(q, [by, "pu", "pv"], "left").fillna({"pixel_class": unknown, "pixel_confidence": 0.0})


def pixel_neighborhood(projected: DataFrame, pixels: DataFrame, radius: int, key: str = "pid", by: str = "frame", unknown: int = -1) -> DataFrame:
    """As ``pixel_lookup``, but of the pixels around a point the most confident, of equals the first by row and column."""
    steps = F.sequence(F.lit(-radius), F.lit(radius))
    p = projected.withColumns({"pu": pixel("u"), "pv": pixel("v")})
    around = p.select(key, by, "pu", "pv").withColumn("dv", F.explode(steps)).withColumn("du", F.explode(steps))
    q = pixels.select(F.col(by).alias("__f"), F.col("u").alias("__u"), F.col("v").alias("__v"), F.col("class_id").alias("pixel_class"), F.col("confidence").alias("pixel_confidence"))
    hit = around.join(q, (around[by] == q["__f"]) & (around["pu"] + around["du"] == q["__u"]) & (around["pv"] + around["dv"] == q["__v"]))
    best = hit.groupBy(key).agg(F.max_by(F.struct("pixel_class", "pixel_confidence"), F.struct("pixel_confidence", -F.col("dv"), -F.col("du"))).alias("b")).select(key, "b.*")
    return p.join(best, key, "left").fillna({"pixel_class": unknown, "pixel_confidence": 0.0})


def fusion_status(assigned: DataFrame, min_confidence: float, classes: int) -> DataFrame:
    """``status`` of looked-up points: confidence is judged before the class."""
    c = F.when(F.col("pixel_confidence") < min_confidence, "low_conf").when((F.col("pixel_class") < 0) | (F.col("pixel_class") >= classes), "unknown").otherwise("assigned")
    return assigned.withColumn("status", c)


def fusion_counters(points: DataFrame, routed: DataFrame, by: str = "frame") -> DataFrame:
    """Per frame: input, projected and what became of them, and invalid, the rest of the input."""
    total = points.groupBy(by).agg(F.count("*").alias("input"))
    kinds = ("assigned", "unknown", "low_conf")
    got = routed.groupBy(by).agg(F.count("*").alias("projected"), *[F.count_if(F.col("status") == k).alias(k) for k in kinds])
    out = total.join(got, by, "left").fillna(0, ["projected", *kinds])
    return out.withColumn("invalid", F.col("input") - F.col("projected"))


def clip_boxes(boxes: DataFrame, width: int, height: int) -> DataFrame:
    """Boxes (x, y, w, h) cut to the image; what lies outside becomes empty."""
    cut_x = lambda e: F.least(F.greatest(e, F.lit(0)), F.lit(width))
    cut_y = lambda e: F.least(F.greatest(e, F.lit(0)), F.lit(height))
    x0, y0, x1, y1 = cut_x(F.col("x")), cut_y(F.col("y")), cut_x(F.col("x") + F.col("w")), cut_y(F.col("y") + F.col("h"))
    return boxes.withColumns({"x": x0, "y": y0, "w": x1 - x0, "h": y1 - y0})


def decode_boxes(candidates: DataFrame, net: tuple[int, int], image: tuple[int, int]) -> DataFrame:
    """Boxes by centre and size in the network's input (cx, cy, bw, bh), letterboxed, to corners in the image."""
    scale = min(net[0] / image[0], net[1] / image[1])
    px, py = (net[0] - image[0] * scale) / 2, (net[1] - image[1] * scale) / 2
    r = lambda c: F.round(c).cast("int")
    return candidates.withColumns({
        "x": r((F.col("cx") - F.col("bw") / 2 - px) / scale), "y": r((F.col("cy") - F.col("bh") / 2 - py) / scale),
        "w": r(F.col("bw") / scale), "h": r(F.col("bh") / scale),
    })


def best_class(candidates: DataFrame, scores: str, threshold: float) -> DataFrame:
    """The class of the largest score, the first of equals; candidates below the threshold go."""
    top = F.array_max(scores)
    return candidates.withColumns({"confidence": top, "class_id": (F.array_position(scores, top) - 1).cast("int")}).filter(F.col("confidence") >= threshold)


def _in_tiles(boxes: DataFrame) -> DataFrame:
    """Boxes of some size once for each tile, TILE pixels wide, that they touch (``tx``, ``ty``)."""
    over = lambda at, size: F.explode(F.sequence(F.floor(F.col(at) / TILE), F.floor((F.col(at) + F.col(size) - 1) / TILE)))
    return boxes.filter("w > 0 AND h > 0").withColumn("tx", over("x", "w")).withColumn("ty", over("y", "h"))


#: Pixels that are painted together, about.
PAINTED = 1 << 20


def _painted(by: str):
    """A task's tiles, each with its boxes in the order in which they are painted, as pixels; see ``class_map``."""
    names = [by, "v", "u", "class_id", "confidence"]

    def spread(size: np.ndarray) -> np.ndarray:
        """0, 1, ... up to each of the sizes."""
        return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)

    def some(rows: pa.Table, held: dict | None) -> tuple[pa.RecordBatch | None, dict]:
        """The pixels of all tiles but the last, which more rows can belong to: that one is ``held`` as it is painted so far."""
        n = {c: np.asarray(rows[c]) for c in ("tx", "ty", "x", "y", "w", "h")}
        image = rows[by].combine_chunks()
        code = np.asarray(pc.fill_null(pc.dictionary_encode(image).indices, -1))
        new = np.r_[True, (code[1:] != code[:-1]) | (n["tx"][1:] != n["tx"][:-1]) | (n["ty"][1:] != n["ty"][:-1])]
        tile = np.cumsum(new) - 1
        begin = np.flatnonzero(new)
        key = lambda at: (image[int(at)].as_py(), int(n["tx"][at]), int(n["ty"][at]))
        goes_on = held is not None and held["key"] == key(0)
        if held is not None and not goes_on:  # a tile of its own ahead of the others
            tile = tile + 1
        tiles = int(tile[-1]) + 1
        top = np.full((tiles, TILE * TILE), -1, np.int64)
        if held is not None:
            top[0, held["at"]] = np.arange(len(held["at"]))
        kept = 0 if held is None else len(held["at"])
        x0, y0 = np.maximum(0, n["x"] - n["tx"] * TILE), np.maximum(0, n["y"] - n["ty"] * TILE)
        wide, high = np.minimum(TILE, n["x"] + n["w"] - n["tx"] * TILE) - x0, np.minimum(TILE, n["y"] + n["h"] - n["ty"] * TILE) - y0
        area = wide * high
        cut_ = np.r_[0, np.flatnonzero(np.diff(np.cumsum(area) // PAINTED)) + 1, len(area)]
        for a, z in zip(cut_[:-1].tolist(), cut_[1:].tolist(), strict=True):
            line = np.repeat(np.arange(a, z), high[a:z])
            row = y0[line] + spread(high[a:z])
            of = np.repeat(np.arange(len(line)), wide[line])
            u = x0[line[of]] + spread(wide[line])
            top[tile[line[of]], row[of] * TILE + u] = kept + line[of]  # of places painted more than once the last one stays
        values = {}
        for c in ("class_id", "confidence"):
            own = rows[c].combine_chunks()
            values[c] = own if held is None else pa.concat_arrays([held[c], own])
        last = np.flatnonzero(top[-1] >= 0)
        from_ = pa.array(top[-1, last])
        at_end = {"key": key(len(code) - 1), "at": last} | {c: v.take(from_) for c, v in values.items()}
        done = top[:-1]
        if not len(done):
            return None, at_end
        t, place = np.nonzero(done >= 0)
        won = pa.array(done[t, place])
        first = begin if held is None or goes_on else np.r_[0, begin]
        tx, ty = n["tx"][first].copy(), n["ty"][first].copy()
        images = image.take(pa.array(first))
        if held is not None:
            tx[0], ty[0] = held["key"][1:]
            images = pa.concat_arrays([pa.array([held["key"][0]], images.type), images.slice(1)])
        v, u = ty[t] * TILE + place // TILE, tx[t] * TILE + place % TILE
        return pa.RecordBatch.from_arrays([images.take(pa.array(t)), pa.array(v.astype(np.int32)), pa.array(u.astype(np.int32)), values["class_id"].take(won), values["confidence"].take(won)], names=names), at_end

    def painted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, schema = None, None
        for batch in batches:
            for i in range(0, batch.num_rows, TILES):
                schema = batch.schema
                out, held = some(pa.Table.from_batches([batch.slice(i, TILES)]), held)
                if out is not None:
                    yield out
        if held is not None:
            image, tx, ty = held["key"]
            place = lambda v: pa.array(v.astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array([image], schema.field(by).type).take(pa.array(np.zeros(len(held["at"]), np.int64))), place(ty * TILE + held["at"] // TILE), place(tx * TILE + held["at"] % TILE), held["class_id"], held["confidence"]], names=names)

    return painted


def _paint(kept: DataFrame, by: str) -> DataFrame:
    ship_package(kept.sparkSession)
    kind = lambda c: kept.schema[c].dataType.simpleString()
    dealt = kept.repartition(by, "tx", "ty").sortWithinPartitions(by, "tx", "ty", F.asc("confidence"), F.asc("order"))
    return dealt.mapInArrow(_painted(by), f"{by} {kind(by)}, v int, u int, class_id {kind('class_id')}, confidence {kind('confidence')}")


def class_map(boxes: DataFrame, by: str = "image_id") -> DataFrame:
    """(image, v, u, class_id, confidence) of all pixels that boxes cover: the most confident wins, the earlier of equals. A null image is one like others.

    Only boxes are shuffled, to the tiles that they touch: those of a tile are painted one over the other as they come, the winner last, the tiles
    of some thousand boxes at once.
    """
    kept = _in_tiles(boxes.select(by, "det_idx", "class_id", "confidence", "x", "y", "w", "h"))
    return _paint(kept.withColumn("order", -F.col("det_idx")), by)


def masked_class_map(boxes: DataFrame, masks: DataFrame, by: str = "image_id") -> DataFrame:
    """As ``class_map``, where a mask (image, det_idx, v, u, weight) overwrites with confidence * weight, if strictly greater.

    A mask's pixel is a box of one pixel behind all boxes, and painted like them: what is shuffled is boxes and masks, no painted pixel.
    """
    flat = boxes.select(by, "det_idx", "class_id", "confidence", "x", "y", "w", "h").withColumn("order", F.lit(0).cast("long"))
    one = F.lit(1)
    weighted = masks.join(boxes.select(by, "det_idx", "class_id", "confidence"), [by, "det_idx"]).select(by, "det_idx", "class_id", (F.col("confidence") * F.col("weight")).alias("confidence"), F.col("u").alias("x"), F.col("v").alias("y"), one.alias("w"), one.alias("h"), F.lit(-1).cast("long").alias("order"))
    # Of equals boxes stay ahead of masks, and of either the earlier.
    both = _in_tiles(flat.unionByName(weighted)).withColumn("order", F.struct("order", -F.col("det_idx")))
    return _paint(both, by)


def iou_pairs(boxes: DataFrame, by: str = "image_id", least: float = 0.0) -> DataFrame:
    """Pairs of one image's boxes that overlap. Boxes meet by the tiles that they touch, so far ones never do."""
    tiles = _in_tiles(boxes)
    a, b = tiles.alias("a"), tiles.alias("b")
    met = a.join(b, [F.col(f"a.{by}").eqNullSafe(F.col(f"b.{by}"))] + [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("tx", "ty")] + [F.col("a.det_idx") < F.col("b.det_idx")])
    # Of the tiles that two boxes share only the first one gives the pair.
    first = (F.col("a.tx") == F.floor(F.greatest("a.x", "b.x") / TILE)) & (F.col("a.ty") == F.floor(F.greatest("a.y", "b.y") / TILE))
    return met.filter(first).select(F.col(f"a.{by}").alias(by), F.col("a.det_idx").alias("det_a"), F.col("b.det_idx").alias("det_b"), iou("a", "b").alias("iou")).filter(F.col("iou") > least)


def suppress(boxes: DataFrame, threshold: float = 0.45, by: str = "image_id") -> DataFrame:
    """Boxes that greedy suppression keeps: by falling confidence, then ``det_idx``, each unless a kept one overlaps it by more than the threshold. ``det_idx`` is unique in an image; boxes without size overlap none.

    In rounds over the graph of overlaps: a box without a better neighbour left is kept, its neighbours go. Edges are as
    many as overlaps, so an image with very many boxes costs no more than what they overlap.
    """
    score = boxes.select(F.col(by).alias("__i"), F.col("det_idx").alias("__d"), F.struct(F.col("confidence"), -F.col("det_idx")).alias("__s"))
    ends = iou_pairs(boxes.select(by, "det_idx", "x", "y", "w", "h"), by, threshold).withColumnRenamed(by, "i")
    of = lambda x: score.select(F.col("__i").alias(f"i_{x}"), F.col("__d").alias(f"d_{x}"), F.col("__s").alias(f"s_{x}"))
    both = ends.join(of("a"), ends["i"].eqNullSafe(F.col("i_a")) & (F.col("det_a") == F.col("d_a"))).join(of("b"), ends["i"].eqNullSafe(F.col("i_b")) & (F.col("det_b") == F.col("d_b")))
    first = F.col("s_a") > F.col("s_b")
    edges = cut(both.select("i", F.when(first, F.col("det_a")).otherwise(F.col("det_b")).alias("better"), F.when(first, F.col("det_b")).otherwise(F.col("det_a")).alias("worse")))
    gone = None
    while not edges.isEmpty():
        # Better ends that are no edge's worse one are kept; what they touch goes, with all edges of either.
        worse = edges.select("i", F.col("worse").alias("better")).distinct()
        on = lambda x, y, end: x["i"].eqNullSafe(y["i"]) & (x[end] == y["better"])
        kept = edges.join(worse, on(edges, worse, "better"), "left_anti")
        now = cut(kept.select("i", F.col("worse").alias("better")).distinct())
        gone = now if gone is None else gone.unionByName(now)
        edges = edges.join(now, on(edges, now, "worse"), "left_anti")
        edges = cut(edges.join(now, on(edges, now, "better"), "left_anti"))
    return boxes if gone is None else boxes.join(gone, boxes[by].eqNullSafe(gone["i"]) & (boxes["det_idx"] == gone["better"]), "left_anti")


def class_names(df: DataFrame, names: DataFrame) -> DataFrame:
    """``class_name`` by ``class_id``; ``class_<id>`` where the table has none."""
    return df.join(names.select("class_id", "class_name"), "class_id", "left").withColumn("class_name", F.coalesce("class_name", F.concat(F.lit("class_"), F.col("class_id").cast("string"))))


def by_score(df: DataFrame, by: str, score: str, key: str) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(score), key)))
