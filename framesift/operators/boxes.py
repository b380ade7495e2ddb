"""Box geometry, class mapping and assembly of annotation tables.

The common schema is annotations(source, image_id, img_w, img_h, cls, x0, y0, x1, y1) in pixels.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from framesift.functions.paths import hash_split, stem

ANNOTATION = ["source", "image_id", "img_w", "img_h", "cls", "x0", "y0", "x1", "y1"]


def _box(cx: Column, cy: Column, w: Column, h: Column) -> Column:
    return F.struct(cx.alias("cx"), cy.alias("cy"), w.alias("w"), h.alias("h"))


def xywh_to_centre(x: Column, y: Column, w: Column, h: Column, img_w: Column | int = 1, img_h: Column | int = 1) -> Column:
    """Corner and size (pixels, or normalised with image size 1) to normalised centre and size."""
    return _box((x + w / 2) / img_w, (y + h / 2) / img_h, w / img_w, h / img_h)


def xyxy_to_centre(x0: Column, y0: Column, x1: Column, y1: Column, img_w: Column | int = 1, img_h: Column | int = 1) -> Column:
    return _box((x0 + x1) / 2 / img_w, (y0 + y1) / 2 / img_h, (x1 - x0) / img_w, (y1 - y0) / img_h)


def oriented_to_centre(corners: Column) -> Column:
    """Eight normalised corner coordinates to the enclosing upright box."""
    xs = F.filter(corners, lambda _, i: i % 2 == 0)
    ys = F.filter(corners, lambda _, i: i % 2 == 1)
    return xyxy_to_centre(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))


def label_line(cls: Column, box: Column) -> Column:
    return F.format_string("%d %.6f %.6f %.6f %.6f", cls, box["cx"], box["cy"], box["w"], box["h"])


def iou(a: list[Column], b: list[Column]) -> Column:
    """Overlap of two x0, y0, x1, y1 boxes as a share of their union; 0 without any area."""
    w = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    h = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    inter = w * h
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inter
    return F.when(union > 0, inter / union).otherwise(F.lit(0.0))


def crop_window(x0: Column, y0: Column, x1: Column, y1: Column, img_w: Column, img_h: Column, least: int = 64) -> Column:
    """struct(left, top, right, bottom) of a context crop around a box: twice its longer side each way, clamped, whole pixels; null below ``least``."""
    half = F.greatest(x1 - x0, y1 - y0) * 2
    cx, cy = (x0 + x1) / 2, (y0 + y1) / 2
    left, top = F.floor(F.greatest(F.lit(0.0), cx - half)).cast("int"), F.floor(F.greatest(F.lit(0.0), cy - half)).cast("int")
    right, bottom = F.floor(F.least(img_w.cast("double"), cx + half)).cast("int"), F.floor(F.least(img_h.cast("double"), cy + half)).cast("int")
    window = F.struct(left.alias("left"), top.alias("top"), right.alias("right"), bottom.alias("bottom"))
    return F.when((right - left >= least) & (bottom - top >= least), window)


def contained(crops: DataFrame, boxes: DataFrame) -> DataFrame:
    """Boxes wholly within a crop of the same image, normalised to the crop.

    ``crops``: crop_id, image_id, left, top, right, bottom, none of them null; ``boxes``: image_id, cls, x0, y0, x1, y1; boxes with a null edge are in no crop.
    """
    edges = ("x0", "y0", "x1", "y1")
    c, b = crops.alias("c"), boxes.dropna(subset=list(edges)).alias("b")
    # one comparison of the smallest margin: four of them are taken apart by the optimiser, which costs ten times the join
    margins = [F.col("b.x0") - F.col("c.left"), F.col("b.y0") - F.col("c.top"), F.col("c.right") - F.col("b.x1"), F.col("c.bottom") - F.col("b.y1")]
    inside = F.least(*margins) >= 0
    joined = c.join(b, (F.col("c.image_id") == F.col("b.image_id")) & inside)
    w, h = F.col("c.right") - F.col("c.left"), F.col("c.bottom") - F.col("c.top")
    box = xyxy_to_centre(F.col("b.x0") - F.col("c.left"), F.col("b.y0") - F.col("c.top"), F.col("b.x1") - F.col("c.left"), F.col("b.y1") - F.col("c.top"), w, h)
    return joined.select("c.crop_id", "c.image_id", "b.cls", box.alias("box"))


def consensus(first: DataFrame, second: DataFrame, least: float = 0.25) -> DataFrame:
    """Boxes of the first model that any box of the second on the same frame overlaps by ``least`` or more."""
    s = second.select(F.col("frame").alias("_f"), *[F.col(c).alias(f"_{c}") for c in ("x0", "y0", "x1", "y1")])
    near = iou([first[c] for c in ("x0", "y0", "x1", "y1")], [s[f"_{c}"] for c in ("x0", "y0", "x1", "y1")]) >= least
    return first.join(s, (first["frame"] == s["_f"]) & near, "left_semi")


def pseudo_labels(first: DataFrame, second: DataFrame, signal: str = "signal", least_conf: float = 0.25) -> DataFrame:
    """Confident boxes of judged frames; ``signal`` boxes only with consensus, and only on frames that keep another box."""
    strong = first.where(F.col("conf") >= least_conf)
    kept = strong.where(F.col("cls") != signal)
    agreed = consensus(strong.where(F.col("cls") == signal), second.where(F.col("cls") == signal))
    return kept.unionByName(agreed.join(kept.select("frame").distinct(), "frame", "left_semi"))


def map_names(names: DataFrame, rules: list[tuple[str, str, str]], column: str = "name") -> DataFrame:
    """Adds ``cls`` by the first rule (kind, text, class) that fits the lower-case name; kinds: is, starts, contains.

    Rules run on the distinct names only, which are then joined back.
    """
    low = F.lower(F.col("_name"))
    tests = {"is": lambda t: low == t, "starts": lambda t: F.startswith(low, F.lit(t)), "contains": lambda t: F.contains(low, F.lit(t))}
    chain = reduce(lambda c, r: c.when(tests[r[0]](r[1]), F.lit(r[2])), rules[1:], F.when(tests[rules[0][0]](rules[0][1]), F.lit(rules[0][2])))
    distinct = names.select(F.col(column).alias("_name")).distinct().withColumn("cls", chain)
    return names.join(distinct, F.col(column) == F.col("_name"), "left").drop("_name")


#: Groups of road-sign codes of the GOST numbering and their class, and words for traffic lights.  Fixed values.
GOST_GROUPS = {"1": "warning", "2": "mandatory", "3": "prohibition", "4": "mandatory", "5": "guide", "6": "guide"}
GOST_SPEED, LIGHT_WORDS = "3.24", ["trafficlight", "traffic_light", "светофор"]


def gost_class(code: Column) -> Column:
    """The class of a road-sign code (``3_24_n20``, ``5.19.1``) by the number of its group; null for plates (7, 8) and what is no code."""
    text = F.trim(code.cast("string"))
    number = F.replace(text, F.lit("_"), F.lit("."))
    group = F.regexp_extract(number, r"^([0-9]+)", 1)
    light = reduce(lambda a, b: a | b, [F.contains(F.lower(text), F.lit(w)) for w in LIGHT_WORDS])
    by_group = F.element_at(F.create_map(*[F.lit(x) for pair in GOST_GROUPS.items() for x in pair]), group)
    return F.when(light, "traffic_light").when((group == "3") & F.startswith(number, F.lit(GOST_SPEED)), "speed_limit").otherwise(by_group)


def new_outputs(rows: DataFrame, existing: DataFrame | None, source: str, path: str = "path") -> DataFrame:
    """Adds ``key``, the source's prefix and the file's stem, and ``split``; of rows with one key the first by path stays, and none whose key ``existing`` has."""
    keyed = rows.withColumn("key", F.concat(F.lit(f"{source}_"), stem(F.col(path))))
    rest = [c for c in keyed.columns if c != "key"]
    one = keyed.groupBy("key").agg(F.min_by(F.struct(*rest), F.struct(path)).alias("_r")).select("_r.*", "key")
    left = one if existing is None else one.join(existing.select(F.col("key").alias("_known")).distinct(), F.col("key") == F.col("_known"), "left_anti")
    return left.withColumn("split", hash_split(F.col("key")))


def parse_label_lines(lines: DataFrame) -> DataFrame:
    """(image_id, cls, box) of label lines ``value``: plain ``cls cx cy w h`` (more fields ignored), or ``cls`` and eight corner coordinates."""
    f = F.filter(F.split(F.trim("value"), r"\s+"), lambda x: x != "")
    numbers = F.transform(F.slice(f, 2, 8), lambda x: x.try_cast("double"))
    plain = F.struct(*[F.get(numbers, F.lit(i)).alias(n) for i, n in enumerate(("cx", "cy", "w", "h"))])
    box = F.when(F.size(f) >= 9, oriented_to_centre(numbers)).when(F.size(f) >= 5, plain)
    return lines.select("image_id", F.get(f, F.lit(0)).try_cast("int").alias("cls"), box.alias("box")).where("cls IS NOT NULL AND box IS NOT NULL")


def unioned(sources: dict[str, DataFrame], stages: list[str] | None = None) -> DataFrame:
    """The chosen annotation sources in one schema."""
    chosen = [sources[n].withColumn("source", F.lit(n)).select(*ANNOTATION) for n in sources if stages is None or n in stages]
    return reduce(DataFrame.unionByName, chosen)


def recipe(annotations: DataFrame, recipes: list[dict]) -> DataFrame:
    """Applies dataset recipes: per source a class map (unmapped dropped) and a cap of images in the order of their ids."""
    out = []
    for r in recipes:
        rows = annotations.where(F.col("source") == r["source"])
        table = F.create_map(*[F.lit(x) for pair in r["classes"].items() for x in pair])
        rows = rows.withColumn("cls", F.try_element_at(table, F.col("cls"))).where("cls IS NOT NULL")
        if r.get("images"):
            first = rows.select("image_id").distinct().orderBy("image_id").limit(r["images"])
            rows = rows.join(first, "image_id", "left_semi")
        out.append(rows)
    return reduce(DataFrame.unionByName, out)


def output_names(rows: DataFrame, path: str = "path", prefix: str = "") -> DataFrame:
    """Adds split, and a file name that a running suffix keeps unique among equal stems."""
    from pyspark.sql import Window as W

    name = F.substring(F.concat(F.lit(prefix), F.regexp_replace(stem(F.col(path)), r"[^0-9A-Za-z_-]", "_")), 1, 80)
    numbered = rows.withColumn("_s", name).withColumn("_i", F.row_number().over(W.partitionBy("_s").orderBy(path)) - 1)
    unique = F.when(F.col("_i") == 0, F.col("_s")).otherwise(F.concat_ws("_", "_s", F.col("_i").cast("string")))
    return numbered.withColumn("name", unique).withColumn("split", hash_split(unique)).drop("_s", "_i")


def with_negatives(images: DataFrame, labels: DataFrame) -> DataFrame:
    """(image_id, lines): sorted label lines of every image, none for negatives."""
    grouped = labels.groupBy("image_id").agg(F.array_sort(F.collect_list("line")).alias("lines"))
    return images.select("image_id").join(grouped, "image_id", "left").withColumn("lines", F.coalesce("lines", F.array().cast("array<string>")))


def mask_boxes(pixels: DataFrame, colours: dict[tuple[int, int, int], str]) -> DataFrame:
    """Enclosing boxes of coloured pixels (image, component, x, y, r, g, b) per component."""
    table = F.create_map(*[x for (r, g, b), c in colours.items() for x in (F.lit(r << 16 | g << 8 | b), F.lit(c))])
    cls = F.try_element_at(table, (F.shiftleft("r", 16).bitwiseOR(F.shiftleft("g", 8)).bitwiseOR(F.col("b"))).cast("int"))
    known = pixels.withColumn("cls", cls).where("cls IS NOT NULL")
    return known.groupBy("image", "component", "cls").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), (F.max("x") + 1).alias("x1"), (F.max("y") + 1).alias("y1"))


def folded_frames(frames: DataFrame, labels: DataFrame, prefix: str) -> DataFrame:
    """(split, name, lines, n_boxes) of labelled frames under a prefixed name; frames (split, stem) without labels (stem, line) stay as
    negatives with no lines.  Blank lines do not count."""
    lines = labels.where(F.trim("line") != "").groupBy(F.col("stem").alias("_s")).agg(F.array_sort(F.collect_list("line")).alias("lines"))
    joined = frames.join(lines, F.col("stem") == F.col("_s"), "left")
    kept = F.coalesce("lines", F.array().cast("array<string>"))
    return joined.select("split", F.concat(F.lit(prefix), "stem").alias("name"), kept.alias("lines"), F.size(kept).alias("n_boxes"))


def line_class_counts(folded: DataFrame) -> DataFrame:
    """Boxes per class, the first field of each line."""
    return folded.select(F.explode("lines").alias("line")).groupBy(F.split(F.trim("line"), r"\s+")[0].alias("cls")).agg(F.count("*").alias("n"))
