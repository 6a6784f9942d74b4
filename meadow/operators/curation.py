"""Curating labelled image sets: duplicates, groups, splits, labels, integrity and balance.

Seeded shuffles are orders by md5(seed | key): the same on every run and for every partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meadow.functions import taxonomy
from meadow.functions.shared import staged
from meadow.operators.components import connected_components
from meadow.params import SPLITS


def shuffle_key(seed: int, *key: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in key]))


# Duplicates


def exact_duplicates(files: DataFrame, content: str = "content", path: str = "path") -> DataFrame:
    """files with md5 and duplicate_of: the first path with the same content, null for that one itself."""
    hashed = files.withColumn("md5", F.md5(F.col(content)))
    first = hashed.groupBy("md5").agg(F.min(path).alias("first"))
    return hashed.join(first, "md5").withColumn("duplicate_of", F.when(F.col(path) != F.col("first"), F.col("first"))).drop("first")


def cached_hashes(files: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files whose hash is known from path, size and mtime; files that must be hashed)."""
    keys = ["path", "size", "mtime"]
    return files.join(cache.select(*keys, "hash"), keys), files.join(cache, keys, "left_anti")


def same_hash_groups(hashed: DataFrame, key: str = "hash") -> DataFrame:
    """Hashes that several files share: how many, and the first of them."""
    return hashed.groupBy(key).agg(F.count("*").alias("n"), F.min("path").alias("first")).where("n > 1")


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def from_hex(text: Column) -> Column:
    """64 bits from 16 hex signs, the top bit as the sign."""
    return F.conv(text, 16, -10).cast("long")


def near_hash_pairs(hashed: DataFrame, most: int = 5, bits: int = 64, cls: str = "cls", key: str = "id", hash_: str = "hash") -> DataFrame:
    """a, b, distance: rows of one class whose hashes differ in up to `most` bits.

    Rows with equal hashes hang on the least of them, one pair each. Of the hashes that are left, the least row of each is
    compared: the hash is cut into most + 1 chunks; one of them must be equal (pigeonhole), so pairs come from equi-joins
    on (class, chunk, its bits), are verified on the whole hash, and count once.
    """
    n = most + 1
    cuts = [(i * bits // n, (i + 1) * bits // n - i * bits // n) for i in range(n)]
    chunks = F.array(*[F.shiftrightunsigned(hash_, at).bitwiseAND(F.lit((1 << w) - 1)) for at, w in cuts])
    first = hashed.groupBy(cls, hash_).agg(F.min(key).alias("id"))
    parts = first.select(cls, "id", F.col(hash_).alias("h"), F.posexplode(chunks).alias("chunk", "bits"))
    a, b = parts.select(cls, "chunk", "bits", F.col("id").alias("a"), F.col("h").alias("ha")), parts.select(cls, "chunk", "bits", F.col("id").alias("b"), F.col("h").alias("hb"))
    met = a.join(b, [cls, "chunk", "bits"]).where("a < b").withColumn("distance", hamming(F.col("ha"), F.col("hb"))).where(F.col("distance") <= most)
    equal = hashed.select(cls, hash_, F.col(key).alias("b")).join(first.withColumnRenamed("id", "a"), [cls, hash_]).where("a <> b")
    return met.select("a", "b", "distance").distinct().unionByName(equal.select("a", "b", F.lit(0).alias("distance")))


def groups_of(rows: DataFrame, pairs: DataFrame, key: str = "id") -> DataFrame:
    """rows with grp: the smallest id that links lead to, their own if there are none."""
    parts = connected_components(pairs).withColumnRenamed("node", key).withColumnRenamed("component", "grp")
    return rows.join(parts, key, "left").withColumn("grp", F.coalesce("grp", key))


def one_per(rows: DataFrame, key: str, order: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def separated(rows: DataFrame, target: Column) -> tuple[DataFrame, DataFrame]:
    """(rows to keep, log of those to remove); a null test removes. Nothing is moved: a caller writes what it wants."""
    ok = F.coalesce(target, F.lit(False))
    return rows.where(ok), rows.where(~ok)


# Splits


def quotas(counts: DataFrame, ratios: tuple[float, ...] = (0.70, 0.15, 0.15), names: tuple[str, ...] = SPLITS) -> DataFrame:
    """counts(cls, n) with q_<split>: largest-remainder shares of n; equal remainders go to the earlier split."""
    exact = [F.col("n") * r for r in ratios]
    floors = [F.floor(F.round(e, 9)) for e in exact]
    left = F.col("n") - sum(floors[1:], floors[0])
    rest = [F.round(e - f, 9) for e, f in zip(exact, floors)]
    out = counts
    for i, name in enumerate(names):
        ahead = sum((F.when((rest[j] > rest[i]) | ((rest[j] == rest[i]) & F.lit(j < i)), 1).otherwise(0) for j in range(len(names)) if j != i), F.lit(0))
        out = out.withColumn(f"q_{name}", floors[i] + F.when(ahead < left, 1).otherwise(0))
    return out


def stratified(rows: DataFrame, cls: str = "cls", key: str = "path", seed: int = 42, ratios: tuple[float, ...] = (0.70, 0.15, 0.15), names: tuple[str, ...] = SPLITS) -> DataFrame:
    """rows with split: within each class, in seeded order, the first ones by quota."""
    q = quotas(rows.groupBy(F.col(cls)).agg(F.count("*").alias("n")), ratios, names).drop("n")
    w = Window.partitionBy(cls).orderBy(shuffle_key(seed, key), key)
    at = rows.withColumn("_n", F.row_number().over(w)).join(q, cls)
    split, upto = F.lit(names[-1]), F.lit(0)
    cases = None
    for name in names[:-1]:
        upto = upto + F.col(f"q_{name}")
        cases = F.when(F.col("_n") <= upto, name) if cases is None else cases.when(F.col("_n") <= upto, name)
    return at.withColumn("split", cases.otherwise(split)).select(*rows.columns, "split")


def grouped_split(rows: DataFrame, cls: str = "cls", grp: str = "grp", seed: int = 1337, ratios: tuple[float, ...] = (0.80, 0.10, 0.10), names: tuple[str, ...] = SPLITS) -> DataFrame:
    """rows with split: whole groups, in seeded order, each to the split that lacks most of its share of the class.

    A fold over the groups of one class (one entry per group, not per row).
    """
    sizes = rows.groupBy(cls, grp).agg(F.count("*").alias("n"))
    per = sizes.groupBy(cls).agg(F.sum("n").alias("total"), F.sort_array(F.collect_list(F.struct(shuffle_key(seed, grp).alias("o"), F.col(grp).alias("grp"), F.col("n").cast("double").alias("n")))).alias("gs"))
    g_type = dict(rows.dtypes)[grp]
    kind = f"struct<have:array<double>,out:array<struct<grp:{g_type},split:string>>>"
    start = F.struct(F.array(*[F.lit(0.0)] * len(names)).alias("have"), F.array().cast(f"array<struct<grp:{g_type},split:string>>").alias("out")).cast(kind)

    def step(a: Column, g: Column) -> Column:
        lack = F.array(*[F.round(F.col("total") * r - F.element_at(a["have"], i + 1), 9) for i, r in enumerate(ratios)])
        best = F.array_position(lack, F.array_max(lack)).cast("int")
        have = F.transform(a["have"], lambda x, i: F.when(i + 1 == best, x + g["n"]).otherwise(x))
        pick = F.struct(g["grp"].alias("grp"), F.element_at(F.array(*[F.lit(n) for n in names]), best).alias("split"))
        return F.struct(have.alias("have"), F.array_append(a["out"], pick).alias("out")).cast(kind)

    given = per.select(cls, F.explode(F.aggregate("gs", start, step)["out"]).alias("g")).select(cls, F.col("g.grp").alias(grp), F.col("g.split").alias("split"))
    return rows.join(given, [cls, grp])


def folder_split(rows: DataFrame, folder: str = "folder", seed: int = 42, names: tuple[str, ...] = SPLITS) -> DataFrame:
    """rows with split: folders in seeded order; a tenth each (one at least) for validation and test. Numbers folders, not rows."""
    folders = rows.select(folder).distinct().withColumn("_o", shuffle_key(seed, folder))
    tenth = folders.agg(F.greatest(F.lit(1), F.floor(F.count("*") / 10)).alias("_tenth"))
    at = numbered(folders, "_o", folder, into="_at").join(F.broadcast(tenth))
    split = F.when(F.col("_at") <= F.col("_tenth"), names[1]).when(F.col("_at") <= 2 * F.col("_tenth"), names[2]).otherwise(names[0])
    return rows.join(at.select(folder, split.alias("split")), folder)


def class_ids(rows: DataFrame, cls: str = "cls") -> DataFrame:
    """rows with class_id: 0, 1, ... by name. Names are numbered alone, by ranges of them, and joined back."""
    names = numbered(rows.select(cls).distinct(), cls, into="class_id")
    return rows.join(names.withColumn("class_id", (F.col("class_id") - 1).cast("int")), cls)


def labels(rows: DataFrame, mode: str = "species", path: str = "path", cls: str = "cls") -> DataFrame:
    """rows with `label`: the class id by name ("species"), or 1 for what the taxon in the path says is a bee, else 0 ("is_bee")."""
    if mode == "species":
        return class_ids(rows, cls).withColumnRenamed("class_id", "label")
    if mode == "is_bee":
        taxon = taxonomy.parse_taxon(F.element_at(F.split(path, "/"), -2))
        return rows.withColumn("label", taxonomy.is_bee(taxon["order"], taxon["family"]).cast("int"))
    raise ValueError(f"no label mode {mode!r}")


def numbered(rows: DataFrame, *order: str, into: str = "place") -> DataFrame:
    """rows numbered from 1 in an order: range partitions, the rows before each of them, and a running number in it.

    The partitions are written first, as a second run of the same shuffle may cut the ranges elsewhere.
    """
    placed = staged(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "numbered")
    n = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = n.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    at = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) + F.col("_before")
    return placed.join(F.broadcast(before), "_part").withColumn(into, at.cast("long")).drop("_part", "_before")


def newest(rows: DataFrame, time: str, key: str, n: int) -> DataFrame:
    """The last n rows by time, ties by the greater key; a top-n, so nothing is sorted as a whole."""
    return rows.orderBy(F.desc(time), F.desc(key)).limit(n)


def pool(splits: dict[str, DataFrame]) -> DataFrame:
    """The rows of several labelled splits with the name of theirs; columns that one lacks are null."""
    out = None
    for name, rows in splits.items():
        named = rows.withColumn("split", F.lit(name))
        out = named if out is None else out.unionByName(named, allowMissingColumns=True)
    if out is None:
        raise ValueError("no splits")
    return out


def capped(rows: DataFrame, by: list[str], most: int, key: str, seed: int = 42) -> DataFrame:
    """Up to `most` rows of each group, in seeded order."""
    w = Window.partitionBy(*by).orderBy(shuffle_key(seed, key), key)
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")


def seeded_sample(rows: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """A sample of n rows (a top-n, so nothing is sorted as a whole)."""
    return rows.withColumn("_o", shuffle_key(seed, key)).orderBy("_o", key).limit(n).drop("_o")


def downsampled(rows: DataFrame, n: int, key: str, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(kept, surplus): the seeded sample and the rest; running it again on what was kept changes nothing."""
    kept = seeded_sample(rows, n, key, seed)
    return kept, rows.join(kept.select(key), key, "left_anti")


def renamed(rows: DataFrame, split: str, name: str, order: str) -> DataFrame:
    """rows with new_name, unique within the split (case apart): later files of one name get _1, _2, ... before the extension.

    Numbers that make a name which a file has already are passed over, so one pass is enough: a made name can only be
    that of its own stem and number.
    """
    low = F.lower(name)
    suffix = r"^(.*)_([1-9][0-9]{0,8})(\.[^.]*)?$"
    like = F.concat(F.regexp_extract(low, suffix, 1), F.regexp_extract(low, suffix, 3))
    taken = rows.where(low.rlike(suffix)).select(F.col(split).alias("_s"), like.alias("_like"), F.regexp_extract(low, suffix, 2).cast("long").alias("_k"))
    taken = taken.groupBy("_s", "_like").agg(F.sort_array(F.collect_set("_k")).alias("_taken"))
    again = F.row_number().over(Window.partitionBy(split, low).orderBy(order)) - 1
    out = rows.withColumn("_n", again.cast("long")).withColumn("_low", low).join(taken, F.col(split).eqNullSafe(F.col("_s")) & (F.col("_low") == F.col("_like")), "left")
    # The n-th number that isn't taken: n and those taken below it.
    free = F.transform("_taken", lambda t, i: t - i - 1)  # how many numbers below it are free
    number = F.col("_n") + F.coalesce(F.size(F.filter(free, lambda x: x < F.col("_n"))), F.lit(0))
    stem, ext = F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract(name, r"(\.[^.]*)$", 1)
    new = F.when(F.col("_n") > 0, F.concat(stem, F.lit("_"), number, ext)).otherwise(F.col(name))
    return out.withColumn("new_name", new).drop("_n", "_low", "_s", "_like", "_taken")


# Labels


def coco_filtered(images: DataFrame, annotations: DataFrame, categories: DataFrame, survivors: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Images whose file_name survives, their annotations, and the categories these use."""
    kept = images.join(survivors.select("file_name").distinct(), "file_name", "left_semi")
    ann = annotations.join(kept.select(F.col("id").alias("image_id")), "image_id", "left_semi")
    return kept, ann, categories.join(ann.select(F.col("category_id").alias("id")).distinct(), "id", "left_semi")


def images_with_boxes(images: DataFrame, boxes: DataFrame) -> DataFrame:
    """Every image with an array of its boxes, empty if it has none."""
    kept = boxes.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct(*[c for c in boxes.columns if c != "image_id"]))).alias("boxes"))
    out = images.join(kept, images["id"] == kept["image_id"], "left").drop("image_id")
    none = F.array().cast(kept.schema["boxes"].dataType)
    return out.withColumn("boxes", F.coalesce("boxes", none))


def with_original_category(images: DataFrame, dims: DataFrame, categories: DataFrame) -> DataFrame:
    """images(file_name, dir) with width and height, and the first category of their directory."""
    first = categories.groupBy("dir").agg(F.min_by("category", "ordinal").alias("category"))
    return images.join(dims, "file_name", "left").join(first, "dir", "left")


def dense_labels(images: DataFrame, annotations: DataFrame, categories: DataFrame) -> DataFrame:
    """One label document per split, ids dense from 0 or 1 by name: split, images, annotations, categories."""
    cats = categories.select(F.col("id").alias("category_id"), "name", (F.row_number().over(Window.orderBy("name")) - 1).alias("cid"))
    img = images.withColumn("iid", F.row_number().over(Window.partitionBy("split").orderBy("file_name")) - 1)
    ann = annotations.join(img.select("split", F.col("id").alias("image_id"), "iid"), "image_id").join(cats, "category_id")
    ann = ann.withColumn("aid", F.row_number().over(Window.partitionBy("split").orderBy("iid", "cid")))
    a = ann.groupBy("split").agg(F.sort_array(F.collect_list(F.struct(F.col("aid").alias("id"), F.col("iid").alias("image_id"), F.col("cid").alias("category_id")))).alias("annotations"))
    i = img.groupBy("split").agg(F.sort_array(F.collect_list(F.struct(F.col("iid").alias("id"), "file_name"))).alias("images"))
    c = cats.agg(F.sort_array(F.collect_list(F.struct(F.col("cid").alias("id"), "name"))).alias("categories"))
    return i.join(a, "split", "left").join(F.broadcast(c))


# Integrity and balance


def leaking_groups(rows: DataFrame, grp: str = "grp", split: str = "split") -> DataFrame:
    """Groups with rows in several splits."""
    return rows.groupBy(grp).agg(F.count_distinct(split).alias("splits"), F.count("*").alias("n")).where("splits > 1")


def missing_in_split(rows: DataFrame, cls: str = "cls", split: str = "split", names: tuple[str, ...] = SPLITS) -> DataFrame:
    """(cls, split) combinations without a row."""
    all_ = rows.select(cls).distinct().withColumn(split, F.explode(F.array(*[F.lit(n) for n in names])))
    return all_.join(rows.select(cls, split).distinct(), [cls, split], "left_anti")


def coverage(rows: DataFrame, cls: str = "cls", split: str = "split", n: int = 3) -> DataFrame:
    """One row: classes, those in all splits, and whether all are."""
    per = rows.groupBy(cls).agg(F.count_distinct(split).alias("s"))
    return per.agg(F.count("*").alias("classes"), F.count_if(F.col("s") == n).alias("covered"), F.coalesce(F.bool_and(F.col("s") == n), F.lit(True)).alias("all_covered"))


def only_in(left: DataFrame, right: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Keys that only the left, and only the right table has."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.join(b, key, "left_anti"), b.join(a, key, "left_anti")


def integrity(manifest: DataFrame, disk: DataFrame) -> DataFrame:
    """Six counters over manifest(path, cls, class_id, split) and disk(path), five examples of the missing, and a verdict."""
    gone, extra = only_in(manifest, disk, "path")
    per = manifest.groupBy("path").agg(F.count("*").alias("n"), F.count_distinct("split").alias("s"))
    ids = manifest.groupBy("cls").agg(F.count_distinct("class_id").alias("n"))
    one = (
        gone.agg(F.count("*").alias("missing"))
        .join(extra.agg(F.count("*").alias("unlisted")))
        .join(per.agg(F.count_if(F.col("n") > 1).alias("repeated"), F.count_if(F.col("s") > 1).alias("in_several_splits")))
        .join(ids.agg(F.count_if(F.col("n") > 1).alias("ambiguous_ids")))
        .join(manifest.agg(F.count_if(F.coalesce(~F.col("split").isin(*SPLITS), F.lit(True))).alias("bad_split")))
        .join(gone.orderBy("path").limit(5).agg(F.sort_array(F.collect_list("path")).alias("examples")))
    )
    checks = ["missing", "unlisted", "repeated", "in_several_splits", "ambiguous_ids", "bad_split"]
    return one.withColumn("passed", sum((F.col(c) for c in checks), F.lit(0)) == 0)


def readiness(checks: DataFrame) -> DataFrame:
    """checks(name, passed) as one row: how many, how many pass, and whether all do."""
    return checks.agg(F.count("*").alias("checks"), F.count_if("passed").alias("passing"), F.coalesce(F.bool_and("passed"), F.lit(True)).alias("ready"))


def distribution(rows: DataFrame, by: str) -> DataFrame:
    return rows.groupBy(by).agg(F.count("*").alias("n")).orderBy(F.desc("n"), by)


def matrix(rows: DataFrame, by: str, across: str, values: list) -> DataFrame:
    return rows.groupBy(by).pivot(across, values).agg(F.count(F.lit(1))).fillna(0)


def imbalance(counts: DataFrame, n: str = "n", most_ratio: float = 10.0, most_gini: float = 0.4) -> DataFrame:
    """Largest over smallest class, Gini coefficient, and whether to rebalance. Ranks one row per class."""
    w = Window.orderBy(n)
    ranked = counts.select(F.col(n).cast("double").alias("x"), F.row_number().over(w).alias("i"))
    a = ranked.agg(F.max("x").alias("top"), F.min("x").alias("low"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("i")).alias("ix"), F.count("*").alias("k"))
    gini = F.coalesce(F.try_divide(2 * F.col("ix"), F.col("k") * F.col("s")) - (F.col("k") + 1) / F.col("k"), F.lit(0.0))
    ratio = F.coalesce(F.try_divide("top", "low"), F.lit(0.0))
    return a.select(ratio.alias("ratio"), gini.alias("gini")).withColumn("rebalance", (F.col("ratio") > most_ratio) | (F.col("gini") > most_gini))


def split_report(rows: DataFrame, split: str = "split", flag: str = "is_bee") -> DataFrame:
    """Rows, share and flagged rows of each split."""
    n = rows.groupBy(split).agg(F.count("*").alias("n"), F.count_if(F.col(flag) == 1).alias("flagged"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def profile(rows: DataFrame, split: str = "split") -> DataFrame:
    """Per split: rows, removed ones and corrupt ones."""
    return rows.groupBy(split).agg(F.count("*").alias("n"), F.count_if(F.col("status") == "removed").alias("removed"), F.count_if(F.col("status") == "corrupt").alias("corrupt"))


def overview(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("files"), *[F.count_distinct(c).alias(f"n_{c}") for c in ("cls", "order", "family")], F.sum("bytes").alias("bytes"), F.avg("bytes").alias("mean_bytes"))


def spread(rows: DataFrame, c: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Min, exact median, upper median (the greater of the two middle values), max, all from aggregates: what the median and
    the lower middle value (the discrete median) leave over is the upper one."""
    low_mid = F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY `{c}`)")
    out = rows.groupBy(*by).agg(F.min(c).alias("low"), F.median(c).alias("median"), F.max(c).alias("top"), F.count(c).alias("n"), low_mid.alias("_mid"))
    kind = dict(rows.dtypes)[c]
    return out.withColumn("upper_median", (2 * F.col("median") - F.col("_mid")).cast(kind)).drop("_mid")


def readable(rows: DataFrame) -> DataFrame:
    """First-word labels and percentages for captions."""
    total = F.sum("n").over(Window.partitionBy())
    return rows.select("*", F.element_at(F.split("name", " "), 1).alias("short"), F.format_string("%.1f%%", F.col("n") * 100.0 / total).alias("pct"))
