"""Open-data portals: what to fetch, given a function that fetches."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession


def table_url(domain: str, table_id: str, limit: int = 1_000_000, form: str = "csv") -> str:
    return f"https://{domain}/resource/{table_id}.{form}?$limit={limit}"


def metadata_url(domain: str, table_id: str) -> str:
    return f"https://{domain}/api/views/metadata/v1/{table_id}"


def catalog_url(domain: str | None = None, offset: int = 0, limit: int = 1000, kind: str = "dataset") -> str:
    """A page of the list of tables, of one domain or of all."""
    own = f"&domains={domain}" if domain else ""
    return f"https://api.us.socrata.com/api/catalog/v1?only={kind}&limit={limit}&offset={offset}{own}"


def domains(fetch: Callable[[str], bytes]) -> list[tuple[str, int]]:
    """Every domain and its number of tables."""
    return [(r["domain"], int(r["count"])) for r in json.loads(fetch("https://api.us.socrata.com/api/catalog/v1/domains"))["results"]]


def datasets(spark: SparkSession, domain: str, n: int, fetch: Callable[[str], bytes], page: int = 1000) -> DataFrame:
    """id, name, names and types of the columns of a domain's first n tables, as ``labels.portal_tables`` takes them.

    Pages are fetched in parallel tasks.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for offset in part["id"]:
                found = json.loads(fetch(catalog_url(domain, int(offset), page)))["results"]
                of = [r["resource"] for r in found]
                yield pd.DataFrame({"id": [r["id"] for r in of], "name": [r["name"] for r in of], "names": [r.get("columns_field_name", []) for r in of], "types": [r.get("columns_datatype", []) for r in of]})

    return spark.range(0, n, page).repartition(-(-n // page) or 1).mapInPandas(run, "id string, name string, names array<string>, types array<string>")


def download(tables: DataFrame, fetch: Callable[[str], bytes], limit: int = 1_000_000) -> DataFrame:
    """id, ok, content or error of each table (domain, id). Ids are fetched in parallel tasks; ``fetch`` is the transport."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for domain, table_id in zip(part["domain"], part["id"]):
                try:
                    rows.append((table_id, True, fetch(table_url(domain, table_id, limit)), None))
                except OSError as e:
                    rows.append((table_id, False, None, str(e)))
            yield pd.DataFrame(rows, columns=["id", "ok", "content", "error"])

    return tables.select("domain", "id").mapInPandas(run, "id string, ok boolean, content binary, error string")
