"""One object over the operators: observe, locate, extract, expand, rules."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.functions import native as N
from pageloom.functions import scalars as S
from pageloom.operators import expansion, extraction, pagegraph, relevance, rulebook, summary, traversal
from pageloom.session import cut, table

FIELDS_DDL = "name string, type string, aliases array<string>, paths array<string>, min double, max double, pattern string, max_chars int, teach string, min_provenance string"


class Pages:
    """Pages of a DataFrame with page_id, url and html.

    Their graph is made once, when it is first needed, and kept as a table in
    the shared folder."""

    def __init__(self, pages: DataFrame):
        if "html" not in pages.columns or "page_id" not in pages.columns:
            raise S.FieldError("SOURCE_REQUIRED", "pages need page_id and html")
        self.pages, self._graph = pages, None

    @property
    def graph(self) -> DataFrame:
        if self._graph is None:
            self._graph = cut(pagegraph.page_graph(self.pages))
        return self._graph

    def observe(self) -> DataFrame:
        """Summary and traversal of each page."""
        t = traversal.traversal(self.graph).drop("url")
        return summary.summarize(self.graph).join(t, "page_id")

    def locate(self, query: str, **how) -> DataFrame:
        if not query.strip():
            raise S.FieldError("QUERY_REQUIRED", "a query needs words")
        return relevance.locate(self.graph, query, **how)

    def extract(self, fields: list, scope: str | None = None, exact: bool = False, **how) -> tuple[DataFrame, DataFrame]:
        """(results, states); `exact` replays whole scopes in order."""
        run = extraction.replay if exact else extraction.extract  # `start` goes on from the states of a RuleStore
        return run(self.pages, fields, scope=None if scope is None else F.lit(scope), **how)

    def expand(self, seeds: DataFrame, **limits) -> dict:
        return expansion.expand(traversal.frontier(self.graph), seeds, **limits)


class RuleStore:
    """Rules and observations as versioned tables in a folder: a version is seen wholly or not at all."""

    def __init__(self, spark: SparkSession, path: str):
        if not path or not path.strip():
            raise S.FieldError("STATE_DIR_UNAVAILABLE", "a rule store needs a folder")
        if os.path.islink(path.rstrip("/")):
            raise S.FieldError("STATE_DIR_SYMLINK", "the folder of a rule store must not be a link")
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._p = jvm.org.apache.hadoop.fs.Path
        self._fs = self._p(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _versions(self) -> list[int]:
        if not self._fs.exists(self._p(self.path)):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(self._p(self.path))]
        return sorted(int(n[1:]) for n in names if n.startswith("v") and n[1:].isdigit())

    def states(self) -> DataFrame:
        v = self._versions()
        return self.spark.read.schema(extraction.STATE).parquet(f"{self.path}/v{v[-1]:09d}") if v else self.spark.createDataFrame([], extraction.STATE)

    def save(self, states: DataFrame, base: int | None = None) -> int:
        """Writes the new version beside the current one, then gives it its name.

        The states given stand in place of those of the same (scope, field); all
        others stay.  `base` is the version that the states go on from: if another
        one was written since, this raises and nothing is changed."""
        now = (self._versions() or [0])[-1]
        if base is not None and now != base:
            raise RuntimeError("another version was written meanwhile")
        old = self.states().join(states.select("scope", "field"), ["scope", "field"], "left_anti")
        return self._write(states.select("scope", "field", "state").unionByName(old), now)

    def version(self) -> int:
        return (self._versions() or [0])[-1]

    def _write(self, states: DataFrame, now: int) -> int:
        v = now + 1
        draft = f"{self.path}/.draft-{uuid.uuid4().hex}"
        states.write.parquet(draft)
        if not self._fs.rename(self._p(draft), self._p(f"{self.path}/v{v:09d}")):
            raise RuntimeError("another version was written meanwhile")
        return v

    def rules(self, scope: str | None = None) -> DataFrame:
        """Rules of all portfolios, best first within a field."""
        rule = "struct<id:bigint,kind:string,pattern:string,origin:string,role:string,hits:bigint,misses:bigint,total_misses:bigint,contradictions:bigint,confirmed_hits:bigint,last_validated:bigint,updated_at:bigint>"
        rows = self.states().select("scope", "field", F.explode(F.from_json("state", f"rules array<{rule}>").rules).alias("r")).select("scope", "field", "r.*")
        return rulebook.listing(rows, scope)

    def forget(self, scope: str, field: str | None = None) -> int:
        """Removes portfolios; gives how many rules went."""
        gone = (F.col("scope") == scope) & (F.lit(True) if field is None else F.col("field") == field)
        n = self.rules(scope).where(gone).count()
        self._write(self.states().where(~gone), self.version())
        return n


def page_functions(spark: SparkSession) -> None:
    """page_blocks(html, url), page_links(html, url) and page_triples(html, url) as table functions, parsed once a row."""
    from pyspark.sql.functions import udtf

    def of(kind: str):
        class Parts:
            def eval(self, html: str, url: str):
                for r in pagegraph.graph_row(0, url or "", html or "")[kind]:
                    yield tuple(r.values())

        return Parts

    for name, kind, ddl in (("page_blocks", "blocks", pagegraph.BLOCK), ("page_links", "links", pagegraph.LINK), ("page_triples", "triples", pagegraph.TRIPLE)):
        spark.udtf.register(name, udtf(of(kind), returnType=ddl.removeprefix("struct<").removesuffix(">")))


def register(spark: SparkSession) -> None:
    """The functions as temporary SQL functions, all of them native expressions, and the web source."""
    from pageloom.functions.patterns import UMLAUTS, UNI_WS
    from pageloom.sources import web

    ws = UNI_WS.replace("\\", "\\\\")
    norm = f"trim(regexp_replace(coalesce(x, ''), '{ws}+', ' '))"
    fold = f"lower({norm})"
    for a, b in UMLAUTS.items():
        fold = f"replace({fold}, '{a}', '{b}')"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION page_normalize(x STRING) RETURNS STRING RETURN {norm}")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION page_fold(x STRING) RETURNS STRING RETURN {fold}")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION page_tokens(x STRING) RETURNS ARRAY<STRING> RETURN regexp_extract_all({fold}, '([a-z0-9]+)', 1)")
    figures = "translate(page_normalize(x), '０１２３４５６７８９٠١٢٣٤٥٦٧٨٩', '01234567890123456789')"
    digits = f"""regexp_replace(regexp_replace(regexp_extract({figures}, "-?[0-9][0-9.,' ]*", 0), "[' ]", ''), '[.,]+$', '')"""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION page_number_digits(x STRING) RETURNS STRING RETURN {digits}")
    dots, commas, no_comma, no_dot = "(length(n) - length(replace(n, '.', '')))", "(length(n) - length(replace(n, ',', '')))", "replace(n, ',', '')", "replace(n, '.', '')"
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION page_number_value(n STRING) RETURNS DOUBLE RETURN try_cast(CASE
        WHEN {dots} > 0 AND {commas} > 0 THEN CASE WHEN length(substring_index(n, '.', -1)) < length(substring_index(n, ',', -1)) THEN {no_comma} ELSE replace({no_dot}, ',', '.') END
        WHEN {commas} > 1 THEN {no_comma} WHEN {commas} = 1 THEN replace(n, ',', '.') WHEN {dots} > 0 AND n RLIKE r'^-?[0-9]{{1,3}}([.][0-9]{{3}})+$' THEN {no_dot} ELSE n END AS DOUBLE)""")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION page_number(x STRING) RETURNS DOUBLE RETURN page_number_value(page_number_digits(x))")
    part = lambda i: f"regexp_extract(coalesce(x, ''), r'{N.URL_PARTS}', {i})"
    host = f"regexp_replace(regexp_replace(regexp_replace(lower({part(2)}), '^.*@', ''), ':[0-9]*$', ''), '^www[.]', '')"
    stem = "regexp_replace(s, r'[.][^.]*$', '')"
    shown = f"transform(slice(filter(split({part(3)}, '/'), s -> s <> ''), 1, 4), s -> CASE WHEN {stem} RLIKE '[0-9]' OR (length({stem}) > 24 AND contains({stem}, '-')) THEN '*' ELSE lower({stem}) END)"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION page_scope(x STRING) RETURNS STRING RETURN CASE WHEN {host} = '' THEN 'inline' ELSE concat({host}, '/', array_join({shown}, '/')) END")
    web.register(spark)
    page_functions(spark)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def safe_call(f, *args, **how) -> dict:
    """What f gives, as {"ok": True, "value"}; any failure as {"ok": False, "error"} with a code, never as an exception."""
    try:
        return {"ok": True, "value": f(*args, **how)}
    except S.FieldError as e:
        return {"ok": False, "error": {"code": e.code, "message": str(e), "recoverable": False}}
    except Exception as e:
        return {"ok": False, "error": {"code": "INTERNAL_ERROR", "message": f"{type(e).__name__}: {e}"[:500], "recoverable": False}}


def page_table(spark: SparkSession, sf_dir: str) -> Pages:
    return Pages(table(spark, sf_dir, "fetch_results"))


__all__ = ["FIELDS_DDL", "N", "Pages", "RuleStore", "exists", "page_table", "register", "safe_call"]
