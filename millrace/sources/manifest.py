"""Listings kept as compressed JSON lines beside the files."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import IndexError_, StoreError
from ..schema import LISTING
from .store import Store, join_uri

PATH = "_manifest/listing"
HEADER = "v int, prefix string, generated_at long, count long"


def _at(store: Store, prefix: str) -> str:
    return join_uri(join_uri(store.root, prefix) if prefix else store.root, PATH)


def write_manifest(store: Store, prefix: str = "") -> int:
    """Writes the listing of a prefix, without manifests themselves; the header is written last, as the mark
    of a whole listing. Returns the number of entries."""
    rows = store.list(prefix).where(~F.contains("key", F.lit(PATH))).select(F.to_json(F.struct("key", "size", "etag", "last_modified")).alias("value"))
    at = _at(store, prefix)
    rows.write.mode("overwrite").option("compression", "gzip").text(f"{at}/entries")
    count = store.spark.read.text(f"{at}/entries").count()
    head = store.spark.createDataFrame([(1, prefix, int(time.time()), count)], HEADER)
    head.select(F.to_json(F.struct("*")).alias("value")).coalesce(1).write.mode("overwrite").option("compression", "gzip").text(f"{at}/header")
    return count


def read_manifest(store: Store, prefix: str = "") -> tuple[dict, DataFrame] | None:
    """Header and entries, or None where there is no manifest; malformed entries are left out."""
    at = _at(store, prefix)
    if not store._fs.exists(store._path(f"{at}/header")):
        return None
    head = store.spark.read.text(f"{at}/header").select(F.from_json("value", HEADER).alias("h")).select("h.*").first()
    if head is None or head["count"] is None:
        raise IndexError_("the manifest has no header")
    lines = store.spark.read.text(f"{at}/entries")
    return head.asDict(), lines.select(F.from_json("value", LISTING).alias("e")).select("e.*").where("key IS NOT NULL AND size IS NOT NULL")


def list_with_manifest(store: Store, prefix: str = "") -> DataFrame:
    """The listing of the manifest if it holds exactly as many entries as it says, else a live one."""
    try:
        found = read_manifest(store, prefix)
        if found and found[1].count() == found[0]["count"]:
            return found[1]
    except (IndexError_, StoreError):
        pass
    return store.list(prefix).where(~F.contains("key", F.lit(PATH)))
