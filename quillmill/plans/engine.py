"""The engine: named queries and configurations, and the commands over them."""

from __future__ import annotations

import inspect
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.functions.sentiment import Scorer
from quillmill.operators import corpus as C
from quillmill.operators import query as Q
from quillmill.operators import relational as R
from quillmill.operators.records import parse
from quillmill.plans import algorithms as A
from quillmill.plans.config import AnalyzerConfig, labelled_queries, parser_config, token_pattern
from quillmill.sources import sinks, tables
from quillmill.sources.checkpoints import checkpoint

#: Options of algorithms and the parameters that they set.
PARAMETERS = {
    "window.size": "window", "ignore.empty.date": "ignore_empty_date", "threshold": "threshold", "add.article.sentiment": "articles",
    "k": "k", "idf": "idf", "min.cf": "min_cf", "min.df": "min_df", "remove.top.n": "remove_top", "iterations": "iterations", "seed": "seed",
}


@dataclass
class Engine:
    """Runs configurations on the tables of a session's catalogue."""

    spark: SparkSession
    namespace: str = "corpus"
    queries: dict[int, Q.Query] = field(default_factory=dict)
    configs: dict[str, str] = field(default_factory=dict)
    manipulators: dict[int, Callable[[list[str]], C.Manipulator]] = field(default_factory=dict)
    warnings: list[str] = field(default_factory=list)
    #: Save points: corpora that were built, by source, dates and manipulators; a longer chain starts from the longest one it begins with.
    _cache: dict[tuple, DataFrame] = field(default_factory=dict)

    def add_query(self, q: Q.Query) -> int:
        number = max(self.queries, default=0) + 1
        self.queries[number] = q
        return number

    def update_query(self, number: int, q: Q.Query) -> None:
        if number not in self.queries:
            raise KeyError(number)
        self.queries[number] = q

    def delete_query(self, number: int) -> None:
        del self.queries[number]

    def duplicate_query(self, number: int) -> int:
        return self.add_query(self.queries[number])

    def add_config(self, name: str, text: str) -> None:
        self.configs[name] = text

    def delete_config(self, name: str) -> None:
        del self.configs[name]

    def test_query(self, q: Q.Query, text: str) -> dict[str, Any]:
        return Q.test_query(q, text)

    # corpora

    def _articles(self, s: tables.Source) -> DataFrame:
        df = self.spark.table(s.table_name(self.namespace))
        dated = s.kind == "parsed"
        return C.articles(df, s.column_name(), F.col("parsed_id") if dated else None, F.col("parsed_datetime") if dated else None, s.label)

    def _built(self, s: tables.Source, cfg: AnalyzerConfig) -> DataFrame:
        """A source's articles in the configured dates, after the chain of manipulators.

        What a chain makes is written once, as a save point in the shared folder.
        """
        arts = self._articles(s)
        if cfg.date_from is not None or cfg.date_to is not None:
            arts = C.filter_by_date(arts, cfg.date_from or "", cfg.date_to or "")
        chain = [(m, cfg.dictionaries[i] if i < len(cfg.dictionaries) else "") for i, m in enumerate(cfg.manipulators) if m]
        if not chain:
            return arts
        base = (s, cfg.date_from, cfg.date_to)
        done = next((n for n in range(len(chain), 0, -1) if (base, tuple(chain[:n])) in self._cache), 0)
        if done:
            arts = self._cache[base, tuple(chain[:done])]
        if done < len(chain):
            arts = checkpoint(C.manipulated(arts, [self.manipulators[m]([d]) for m, d in chain[done:]]))
            self._cache[base, tuple(chain)] = arts
        return arts

    def corpora(self, cfg: AnalyzerConfig) -> list[DataFrame]:
        """The article tables of a configuration: by date, manipulated, combined, then filtered by queries on their tokens."""
        good, warned = tables.usable(self.spark, cfg.sources, self.namespace)
        self.warnings += warned
        out = [self._built(s, cfg) for s in good]
        if cfg.combine and len(out) > 1:
            out = [C.combine(out)]
        queries = [self.queries[q] for q in cfg.filter_queries if q in self.queries]
        return [C.filter_by_queries(a, queries, cfg.filter_all) for a in out] if queries else out

    def tokens(self, cfg: AnalyzerConfig) -> DataFrame:
        """The token table of all sources after the chain of manipulators."""
        return reduce(DataFrame.unionByName, [C.tokens(a) for a in self.corpora(cfg)])

    def forget(self) -> None:
        """Drops save points, as after their sources have changed."""
        self._cache.clear()

    # commands

    def algorithm(self, cfg: AnalyzerConfig) -> A.Algorithm:
        kind = A.REGISTRY[cfg.algorithm]
        takes = inspect.signature(kind).parameters
        o = cfg.algorithm_options
        kw: dict[str, Any] = {PARAMETERS[k]: v for k, v in o.items() if k in PARAMETERS and PARAMETERS[k] in takes}
        if "resolution" in takes:
            kw |= {"resolution": cfg.resolution, "fill": cfg.fill_gaps}
        if "categories" in takes:
            kw["categories"] = labelled_queries(o, self.queries)
        if "keyword" in takes:
            kw["keyword"] = token_pattern(self.queries[o["keyword"]]) if o.get("keyword") in self.queries else ""
        if "threshold" in takes and not o.get("use.threshold", "threshold" in o):
            kw["threshold"] = None
        if "scorer" in takes and isinstance(o.get("dictionary"), dict):
            kw["scorer"] = Scorer(o["dictionary"], o.get("emojis") or {})
        return kind(**kw)

    def run(self, cfg: AnalyzerConfig | str, save: bool = False) -> DataFrame:
        """The sorted result of an analysis over all its sources.

        ``save`` also writes its target table and those of its further results.
        """
        cfg = AnalyzerConfig.from_json(self.configs.get(cfg, cfg)) if isinstance(cfg, str) else cfg
        algo = self.algorithm(cfg)
        corpora = self.corpora(cfg)
        if not corpora:
            raise ValueError("no usable source")
        join = lambda parts: reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
        out = join([algo.run(arts) for arts in corpora])
        by = [c for c in algo.order if c in out.columns]
        out = out.orderBy(*by) if by else out
        if save:
            target = f"{self.namespace}_analyzed_{cfg.target}"
            sinks.replace(out, target)
            further = [algo.extra(arts) for arts in corpora]
            for name in further[0]:
                sinks.replace(join([f[name] for f in further]), f"{target}_{name}")
        return out

    def parse(self, config: str, crawled: DataFrame) -> DataFrame:
        return parse(crawled, parser_config(self.configs.get(config, config), self.queries))

    def import_urls(self, path: str, known: DataFrame, skip_first: bool = False) -> DataFrame:
        """URLs of a text list that a URL list lacks."""
        return R.add_if_new(known, tables.import_list(self.spark, path, skip_first))

    def export_urls(self, urls: DataFrame, path: str, header: bool = False, compression: str = "none") -> None:
        sinks.export_list(urls, path, "url", header, compression)

    def merge_urls(self, lists: list[DataFrame]) -> DataFrame:
        return R.merge_lists(lists)

    def delete_urls(self, urls: DataFrame, number: int) -> DataFrame:
        """URLs that a query doesn't match."""
        q = self.queries[number]
        named = Q.evaluate(urls, "url", {"_q": Q.Query(q.type, q.text, "bool")})
        return named.where("not _q").drop("_q")

    def reset_status(self, state: DataFrame) -> DataFrame:
        return R.reset_state(state)
