"""The engine's surface: ingest sources, search, assemble data, explain."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import correlate, index, joins, measures
from tidemark.operators.counters import Counters
from tidemark.plans.search import Options, correlations
from tidemark.sources.catalog import Catalog
from tidemark.sources.results import to_results


class Engine:
    """One catalog of aggregated tables in long form, and what is asked of it."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.catalog = spark, Catalog(spark, root)

    def ingest(self, sources: list[measures.Source], cross: bool = True) -> None:
        """Aggregate sources by all their keys and add them to the catalog: measures, statistics, profiles and index.

        Sources that are there already are replaced, all others stay as they are: tables are split by source, and the
        index takes in the keys that these sources gain or lose.
        """
        names = [s.tbl for s in sources]
        if not names:
            return
        catalog = self.catalog
        catalog.replace_parts("measures", measures.measures(sources, cross), "tbl", names)
        own = catalog.own("measures").filter(F.col("tbl").isin(names))
        catalog.replace_parts("stats", measures.column_stats(own, by=("tbl", "agg", "var")), "tbl", names)
        catalog.replace_parts("value_profiles", measures.value_profile(own, by=("tbl", "agg", "var")), "tbl", names)
        profiles = [measures.column_profile(s.df, s.tbl, s.measures) for s in sources if s.measures]
        if profiles:
            catalog.replace_parts("profiles", reduce(DataFrame.unionByName, profiles), "tbl", names)
        catalog.update_keys(measures.keys_of(own), names)

    def remove(self, tables: list[str]) -> None:
        """Take sources out of measures, statistics, profiles and index; unknown names change nothing."""
        keys = self.catalog.own("keys")
        self.catalog.update_keys(keys.select("kind", "agg", "tbl", "val").limit(0), tables)
        for name in ("measures", "stats", "value_profiles", "profiles"):
            self.catalog.drop_parts(name, "tbl", tables)

    @property
    def long(self) -> DataFrame:
        return self.catalog.read("measures")

    def find_correlations_from(self, tbl: str, options: Options = Options(), controls: list[tuple[str, str]] | None = None) -> DataFrame:
        """Correlations of one table's variables; with ``controls`` (agg, var) those found are taken again with these held fixed."""
        found = correlations(self.long, options, tbl)
        if not controls:
            return self._shown(found)
        return correlate.partial_pairs(self.long, found, controls)

    def store_features(self) -> DataFrame:
        """Peaks and dips of all variables, stored beside the measures for later tests of relationships."""
        from tidemark.operators import topology

        self.catalog.write("features", topology.features(self.long))
        return self.catalog.read("features")

    def relationships(self) -> DataFrame:
        """Topological relationships of all variables, from the stored features."""
        from tidemark.operators import topology

        found = self.catalog.read("features")
        return topology.relationships(found, found)

    def merge(self, other: "Engine") -> "Engine":
        """Search the tables of both."""
        self.catalog.merge(other.catalog)
        return self

    def find_all_correlations(self, options: Options = Options(correction="FDR"), path: str | None = None, watch: Counters | None = None) -> DataFrame:
        """Correlations of all tables; with a ``path`` they are written too, and ``watch`` counts what each phase saw."""
        from tidemark.sources.results import write_results

        found = self._shown(correlations(self.long, options, watch=watch))
        if path:
            write_results(found, path)
        return found

    def control_variables(self, corrs: DataFrame | list[tuple[str, str, str, str]], controls: list[tuple[str, str]]) -> DataFrame:
        """Correlations (agg1, var1, agg2, var2) again with the variables (agg, var) held fixed."""
        if not isinstance(corrs, DataFrame):
            corrs = self.spark.createDataFrame(corrs, "agg1 string, var1 string, agg2 string, var2 string")
        return correlate.partial_pairs(self.long, corrs, controls)

    def control_by_table(self, corrs: DataFrame | list[tuple[str, str, str, str]], agg: str, counted: bool = False) -> DataFrame:
        """Correlations again with all variables that its raw table offers as controls held fixed, of an aggregated table."""
        tbl = self.long.filter(F.col("agg") == agg).select("tbl").first()["tbl"]
        return self.control_variables(corrs, [(agg, v) for v in self.catalog.entries[tbl].control_variables(counted)])

    def join_and_project(self, variables: list[tuple[str, str]], constraints: dict[str, int] | None = None, samples: bool = False) -> DataFrame:
        tables = {a: self.catalog.read_agg(a) for a in dict.fromkeys(t for t, _ in variables)}
        return joins.join_and_project(tables, variables, constraints, samples)

    def regress(self, target: tuple[str, str], inputs: list[tuple[str, str]], estimator=None):
        frame = self.join_and_project([target, *inputs])
        return correlate.regress(frame, "_".join(target)[:63], ["_".join(v)[:63] for v in inputs], estimator)

    def joined_row(self, row) -> DataFrame:
        return joins.joined_row({a: self.catalog.read_agg(a) for a in (row["agg_table1"], row["agg_table2"])}, row)

    def explain_discovery(self, overlap: int) -> DataFrame:
        """What searching the index and joining all tables would cost each table, and the choice between them."""
        return index.choose_method(measures.keys_of(self.long), overlap)

    def profile_of(self, row) -> str:
        """A correlation's variables, ratios, coefficient, p-value and samples as text."""
        lines = [f"{s}: {row[f'table_id{s}']} {row[f'agg_table{s}']} {row[f'agg_attr{s}']} missing {row[f'original_attr{s}_missing_ratio']} zero {row[f'original_attr{s}_zero_ratio']}" for s in "12"]
        return "\n".join([*lines, f"r {row['correlation coefficient']} p {row['p value']} n {row['number of samples']} {row['spatio-temporal key type']}"])

    def _shown(self, corrs: DataFrame) -> DataFrame:
        entries = self.catalog.entries.values()
        told = {f"{e.tbl}.{c}": t for e in entries for c, t in e.descriptions.items()}
        return to_results(
            corrs, self.catalog.read("stats").drop("tbl"), self.catalog.read("profiles"), {e.tbl: e.name for e in entries}, values=self.catalog.read("value_profiles").drop("tbl"),
            domains={e.tbl: e.domain for e in entries}, descriptions=told,
        )


class Assistant:
    """Questions about a correlation for a language model that the caller supplies as a function of a prompt."""

    def __init__(self, ask: Callable[[str], str], row: dict):
        self.ask = ask
        self.facts = (
            f"Variable {row['agg_attr1']} of table {row['table_name1']} and variable {row['agg_attr2']} of table {row['table_name2']} have a correlation of "
            f"{row['correlation coefficient']} (p = {row['p value']}, n = {row['number of samples']}). "
        )
        self.one, self.two = row["agg_attr1"], row["agg_attr2"]

    def summarize(self) -> str:
        return self.ask(self.facts + "Say in one sentence what this means.")

    def explain(self) -> str:
        return self.ask(self.facts + "Give a short account of why the two could move together.")

    def reference(self) -> str:
        return self.ask(self.facts + "Which published studies, with sources, look into this relation?")

    def confounder(self) -> str:
        return self.ask(self.facts + "Which other variables could drive both?")

    def is_interesting(self, explain: bool = False) -> str:
        return self.ask(self.facts + "Is it worth a study? Answer yes or no." + (" Give your reasons." if explain else ""))

    def causal_direction(self, explain: bool = False) -> str:
        choices = f"A: {self.one} causes {self.two}. B: {self.two} causes {self.one}. C: neither causes the other."
        return self.ask(self.facts + f"Which is likeliest? {choices} Answer A, B or C." + (" Give your reasons." if explain else ""))

    @staticmethod
    def suggest_controls(ask: Callable[[str], str], rows: list[dict]) -> str:
        facts = "\n".join(f"{r['agg_attr1']} ({r['table_name1']}) ~ {r['agg_attr2']} ({r['table_name2']}): {r['correlation coefficient']}" for r in rows)
        return ask("Which variables should be held fixed to leave fewer of these correlations?\n" + facts)


def degree_ranking(corrs: DataFrame) -> DataFrame:
    """tbl, var, degree: in how many correlations each variable stands, most first."""
    ends = corrs.select(F.col("tbl1").alias("tbl"), F.col("var1").alias("var")).unionAll(corrs.select("tbl2", "var2"))
    return ends.groupBy("tbl", "var").agg(F.count(F.lit(1)).alias("degree")).orderBy(F.desc("degree"), "tbl", "var")
