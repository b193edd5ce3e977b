"""Sources beyond the cluster, by functions that the user injects; the library opens no connection itself."""

from __future__ import annotations

import shutil
from collections.abc import Callable, Iterator
from pathlib import Path
from typing import BinaryIO

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: From a mention the ids of found records, best first; and from such ids the place ids that each claims.
Search = Callable[[str], list[str]]
Claims = Callable[[list[str]], dict[str, list[str]]]

SEARCHED, MOST_IDS = 3, 5


def download(sources: list[tuple[str, str]], opened: Callable[[str], BinaryIO]) -> list[str]:
    """Each (address, file) fetched in chunks, unless the file is there and not empty; the files that were fetched."""
    fetched = []
    for address, name in sources:
        target = Path(name)
        if target.exists() and target.stat().st_size:
            continue
        target.parent.mkdir(parents=True, exist_ok=True)
        part = target.with_name(target.name + ".part")  # a broken transfer leaves no file that looks whole
        with opened(address) as source, part.open("wb") as out:
            shutil.copyfileobj(source, out, 1 << 18)
        part.replace(target)
        fetched.append(name)
    return fetched


def searched_exonyms(mentions: DataFrame, places: DataFrame, search: Search, claims: Claims) -> DataFrame:
    """``(key, ord, id)`` of ids that a search finds for each distinct ``mentions(key)`` and that ``places`` has, roads and buildings left out.

    The first three records are looked into, the first five ids kept; a failing call finds nothing.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for key in pdf["key"]:
                try:
                    found = search(key)[:SEARCHED]
                    own = claims(found) if found else {}
                except Exception:
                    continue
                ids = dict.fromkeys(i for record in found for i in own.get(record, ()))
                rows += [(key, k, i) for k, i in enumerate(ids)]
            yield pd.DataFrame(rows, columns=["key", "at", "id"])

    asked = mentions.select("key").where("key is not null").distinct().mapInPandas(run, "key string, at int, id string")
    solid = places.where("coalesce(feature_class, '') not in ('R', 'S')").select(F.col("geonameid").alias("id"))
    lists = asked.join(solid, "id", "left_semi").groupBy("key").agg(F.slice(F.array_sort(F.collect_list(F.struct("at", "id"))), 1, MOST_IDS).alias("c"))
    return lists.select("key", F.posexplode(F.transform("c", lambda c: c["id"])).alias("ord", "id"))
