"""A keyed table in buckets: an upsert rewrites the small buckets it touches and adds to the large ones, and readers swap at once.

A row lies in the bucket of a hash of its key.  The folder of a version holds the buckets that version rewrote, and the manifest of a
version names, for every bucket, the folder that holds it.  A reader takes the newest manifest and reads the folders it
names; those of a version in the making are named by none.  A delete writes the keys that are gone beside the rows, and so does an
upsert of a large bucket for keys that it had: a reader leaves out rows of older versions with those keys.  A bucket of ``MOST_LAYERS``
such additions is rewritten.  A manifest is written under a name that must not exist yet, so of two
writers that start from the same version one fails and nothing is lost.  Writing the same rows again rewrites their buckets with the same
rows.  ``vacuum`` removes what no kept manifest names.

Defined results: a null key is a key like any other; of several incoming rows with one key, the last by ``version`` columns stays, and
without such columns any one; a delete of keys that are not there changes nothing but the version.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace
from functools import reduce
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lexquarry.operators.tenancy import latest
from lexquarry.sizing import fits

BUCKETS = 256
BROADCAST_KEYS = 200_000
#: Bytes beyond which a bucket is added to, and additions after which it is rewritten.
APPEND_BYTES, MOST_LAYERS = 4 << 20, 8
#: What the folder of the keys that a version took out adds to the name of its rows.
GONE = "-gone"


@dataclass(frozen=True)
class Manifest:
    """Version number, key, buckets, the folder that holds each bucket that has rows, and the folders that were added to it since."""

    version: int
    key: list[str]
    buckets: int
    held: dict[int, str]
    schema: str
    layout: list[str]
    layers: dict[int, list[str]] = field(default_factory=dict)


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _versions(spark: SparkSession, store: str) -> list[int]:
    fs, p = _path(spark, f"{store}/manifests")
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def manifest(spark: SparkSession, store: str, version: int | None = None) -> Manifest | None:
    """The newest manifest, or that of a version; none where nothing was written yet."""
    known = _versions(spark, store)
    if not known or (version is not None and version not in known):
        return None
    fs, p = _path(spark, f"{store}/manifests/{known[-1] if version is None else version:010d}.json")
    stream = fs.open(p)
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    raw = json.loads(text)
    return Manifest(raw["version"], raw["key"], raw["buckets"], {int(b): v for b, v in raw["held"].items()}, raw["schema"], raw["layout"],
                    {int(b): v for b, v in raw.get("layers", {}).items()})


def _commit(spark: SparkSession, store: str, new: Manifest) -> None:
    """Write the manifest; fails if its version exists."""
    fs, p = _path(spark, f"{store}/manifests/{new.version:010d}.json")
    stream = fs.create(p, False)
    try:
        stream.write(bytearray(json.dumps(vars(new), sort_keys=True).encode()))
    finally:
        stream.close()


def bucket_of(key: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")


def read(spark: SparkSession, store: str, only: list[int] | None = None, version: int | None = None) -> DataFrame:
    """The rows of the newest version, or of an older one; of some buckets if ``only`` names them."""
    now = manifest(spark, store, version)
    if now is None:
        raise FileNotFoundError(f"no table at {store}")
    schema = spark.createDataFrame([], now.schema).schema
    rows: dict[str, list[int]] = {}
    gone: dict[str, list[int]] = {}
    for b in sorted(b for b in now.held if only is None or b in set(only)):
        for v in [now.held[b], *now.layers.get(b, [])]:
            (gone if v.endswith(GONE) else rows).setdefault(v, []).append(b)

    def stored(folder: str, buckets: list[int], columns: list[str]) -> DataFrame:
        paths = [f"{store}/data/{folder}/bucket={b}" for b in buckets]
        fields = spark.createDataFrame([], schema).select(*columns).schema
        return spark.read.schema(fields).option("basePath", f"{store}/data/{folder}").parquet(*paths).select(*columns)

    parts = []
    for v, held in rows.items():
        part = stored(v, held, schema.fieldNames())
        later = [stored(g, sorted({*of} & {*held}), now.key) for g, of in gone.items() if g.split("-")[0] > v.split("-")[0] and {*of} & {*held}]
        parts.append(_matching(part, reduce(DataFrame.unionByName, later), now.key, "left_anti") if later else part)
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)


def lookup(spark: SparkSession, store: str, keys: DataFrame, version: int | None = None) -> DataFrame:
    """Rows with the given keys, from their buckets; of the newest version or of an older one."""
    now = manifest(spark, store, version)
    touched = [r[0] for r in keys.select(bucket_of(now.key, now.buckets)).distinct().collect()]
    return _matching(read(spark, store, touched, version), keys, now.key, "left_semi")


def _matching(rows: DataFrame, keys: DataFrame, key: list[str], how: str) -> DataFrame:
    """Semi or anti join on equal keys, nulls included."""
    wanted = keys.select(*(F.col(k).alias(f"_k_{i}") for i, k in enumerate(key))).distinct()
    same = [rows[k].eqNullSafe(F.col(f"_k_{i}")) for i, k in enumerate(key)]
    return rows.join(F.broadcast(wanted) if fits(wanted, BROADCAST_KEYS) else wanted, reduce(lambda a, b: a & b, same), how)


def _filled(spark: SparkSession, target: str) -> set[int]:
    fs, p = _path(spark, target)
    return {int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(p) if s.getPath().getName().startswith("bucket=")}


def _fresh(now: Manifest) -> str:
    # a name of its own: another writer of this version writes elsewhere
    return f"{now.version + 1:010d}-{uuid4().hex}"


def _write(spark: SparkSession, store: str, now: Manifest, rows: DataFrame, touched: list[int], order: list[str] | None = None,
           added: list[int] = (), taken: list[int] = (), folder: str | None = None) -> Manifest:
    """Write the touched buckets as a new version and publish it; ``order`` names what tells rows of one key apart.

    Rows are laid over the buckets of ``added``, whose keys of ``taken`` were written already to the folder of what is gone.  Rows are
    shuffled once, by bucket and a part of it, and meet those of their key there.
    """
    folder = folder or _fresh(now)
    target = f"{store}/data/{folder}"
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // max(len(touched), 1))
    placed = rows.withColumns({"bucket": bucket_of(now.key, now.buckets), "_part": F.pmod(F.hash(*now.key), F.lit(parts))})
    placed = placed.repartition("bucket", "_part")
    if order:
        placed = latest(placed, ["bucket", "_part", *now.key], order).drop(*order)
    placed.drop("_part").write.partitionBy("bucket", *now.layout).parquet(target)
    filled = _filled(spark, target)
    anew = set(touched) - set(added)
    held = {b: v for b, v in now.held.items() if b not in anew} | {b: folder for b in filled & anew}
    layers = {b: v for b, v in now.layers.items() if b not in anew}
    for b in sorted({*added} & filled):
        layers[b] = [*layers.get(b, []), *([folder + GONE] if b in taken else []), folder]
    new = replace(now, version=now.version + 1, held=held, layers=layers)
    _commit(spark, store, new)
    return new


def _take(spark: SparkSession, store: str, now: Manifest, keys: DataFrame, folder: str) -> list[int]:
    """Write keys that are gone beside the rows of ``folder``; returns their buckets."""
    placed = keys.select(*now.key).withColumn("bucket", bucket_of(now.key, now.buckets)).where(F.col("bucket").isin(sorted(now.held)))
    placed.repartition("bucket").write.partitionBy("bucket").parquet(f"{store}/data/{folder}{GONE}")
    return sorted(_filled(spark, f"{store}/data/{folder}{GONE}"))


def _bytes(spark: SparkSession, store: str, now: Manifest, bucket: int) -> int:
    total = 0
    for v in [now.held[bucket], *now.layers.get(bucket, [])]:
        fs, p = _path(spark, f"{store}/data/{v}/bucket={bucket}")
        total += fs.getContentSummary(p).getLength()
    return total


def _start(spark: SparkSession, store: str, incoming: DataFrame, key: list[str] | None, buckets: int, layout: list[str]) -> Manifest:
    now = manifest(spark, store)
    if now is not None:
        return now
    if not key:
        raise ValueError("a new table needs a key")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in incoming.schema.fields)
    return Manifest(-1, key, buckets, {}, fields, layout)


def upsert(incoming: DataFrame, store: str, key: list[str] | None = None, version: list[str] | None = None, buckets: int = BUCKETS,
           layout: list[str] | None = None) -> Manifest:
    """Lay rows over those with the same key.  The first call makes the table, with its key, buckets and folders within a bucket.

    Only buckets of incoming keys are read and written; of a bucket beyond ``APPEND_BYTES`` only the keys, unless ``version`` is given.
    Incoming rows win over stored ones unless ``version`` columns say otherwise.
    """
    spark = incoming.sparkSession
    now = _start(spark, store, incoming, key, buckets, layout or [])
    touched = sorted(r[0] for r in incoming.select(bucket_of(now.key, now.buckets)).distinct().collect())
    new = incoming.withColumn("_new", F.lit(1))
    old = [b for b in touched if b in now.held]
    added = [] if version else [b for b in old if len(now.layers.get(b, [])) < MOST_LAYERS and _bytes(spark, store, now, b) > APPEND_BYTES]
    folder, taken = _fresh(now), []
    if added:
        known = read(spark, store, added, now.version).select(*now.key)
        again = _matching(known, incoming.where(bucket_of(now.key, now.buckets).isin(added)), now.key, "left_semi")
        taken = _take(spark, store, now, again, folder)
    old = [b for b in old if b not in added]
    if old:
        new = new.unionByName(read(spark, store, old, now.version).withColumn("_new", F.lit(0)))
    if not version:
        return _write(spark, store, now, new, touched, ["_new"], added, taken, folder)
    return _write(spark, store, now, latest(new, now.key, [*version, "_new"]).drop("_new"), touched)


def delete(doomed: DataFrame, store: str) -> Manifest:
    """Remove the rows with the keys of ``doomed``: the keys are written, and buckets with many such additions are rewritten."""
    spark = doomed.sparkSession
    now = manifest(spark, store)
    folder = _fresh(now)
    taken = _take(spark, store, now, doomed.select(*now.key).distinct(), folder)
    new = replace(now, version=now.version + 1, layers=now.layers | {b: [*now.layers.get(b, []), folder + GONE] for b in taken})
    _commit(spark, store, new)
    full = [b for b in taken if len(new.layers[b]) > MOST_LAYERS]
    return _write(spark, store, new, read(spark, store, full, new.version), full) if full else new


def vacuum(spark: SparkSession, store: str, keep: int = 1) -> list[int]:
    """Remove manifests but the newest ``keep``, and folders of versions that none of those names; returns the removed versions."""
    known = _versions(spark, store)
    if not known:
        return []
    kept, gone = known[-keep:], known[:-keep]
    manifests = [manifest(spark, store, k) for k in kept]
    named = {v for m in manifests for v in [*m.held.values(), *(v for layers in m.layers.values() for v in layers)]}
    removed = []
    for v in gone:
        fs, p = _path(spark, f"{store}/manifests/{v:010d}.json")
        fs.delete(p, False)
    fs, p = _path(spark, f"{store}/data")
    for status in fs.listStatus(p):
        name = status.getPath().getName()
        # a folder beyond the newest manifest may be in the making
        if name not in named and int(name.split("-")[0]) <= known[-1]:
            fs.delete(status.getPath(), True)
            removed.append(int(name.split("-")[0]))
    return sorted(removed)
