"""Bibliographic candidates: one schema, deduplication, links, formats, names, the catalogue and ranking.

A record is record_id, provider, title, authors (array), year, doi, citations, oa_url, venue, type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quireworks.functions.graph import smallest_reachable
from quireworks.functions.lineage import save
from quireworks.functions.text import strip

#: Explicit schemas of the four providers' JSON lines.
SCHEMAS = {
    "semantic_scholar": "paperId string, title string, authors array<struct<name string>>, year int, externalIds struct<DOI string>, citationCount bigint, openAccessPdf struct<url string>, venue string, publicationTypes array<string>",
    "crossref": "DOI string, title array<string>, author array<struct<given string, family string>>, `published-print` struct<`date-parts` array<array<int>>>, `is-referenced-by-count` bigint, `container-title` array<string>, type string",
    "openalex": "id string, title string, authorships array<struct<author struct<display_name string>>>, publication_year int, doi string, cited_by_count bigint, open_access struct<oa_url string>, type string",
    "unpaywall": "doi string, title string, year int, best_oa_location struct<url_for_pdf string, url string>, oa_locations array<struct<url_for_pdf string, url string>>, journal_name string, genre string",
}


def read_bib(spark: SparkSession, path: str, provider: str) -> DataFrame:
    """A provider's JSON lines, by its schema."""
    return spark.read.schema(SCHEMAS[provider]).json(path)


def bare_doi(doi: Column) -> Column:
    return F.nullif(F.lower(F.regexp_replace(strip(doi), r"(?i)^https?://(dx\.)?doi\.org/", "")), F.lit(""))


def normalise(records: DataFrame, provider: str) -> DataFrame:
    """A provider's records in the one schema, without record_id."""
    c, none = F.col, lambda kind: F.lit(None).cast(kind)
    columns = {
        "semantic_scholar": lambda: (c("title"), F.transform("authors", lambda a: a["name"]), c("year"), c("externalIds.DOI"), c("citationCount"), c("openAccessPdf.url"), c("venue"), F.get("publicationTypes", F.lit(0))),
        "crossref": lambda: (F.get("title", F.lit(0)), F.transform("author", lambda a: F.concat_ws(" ", a["given"], a["family"])), F.get(F.get(c("published-print.date-parts"), F.lit(0)), F.lit(0)), c("DOI"), c("is-referenced-by-count"), none("string"), F.get("container-title", F.lit(0)), c("type")),
        "openalex": lambda: (c("title"), F.transform("authorships", lambda a: a["author"]["display_name"]), c("publication_year"), c("doi"), c("cited_by_count"), c("open_access.oa_url"), none("string"), c("type")),
        "unpaywall": lambda: (c("title"), none("array<string>"), c("year"), c("doi"), none("bigint"), first_location(), c("journal_name"), c("genre")),
    }[provider]()
    names = ("title", "authors", "year", "doi", "citations", "oa_url", "venue", "type")
    return records.select(F.lit(provider).alias("provider"), *[(bare_doi(x) if n == "doi" else x).alias(n) for n, x in zip(names, columns, strict=True)])


def first_location() -> Column:
    """The best location's link, else the first link of any location."""
    links = F.filter(F.transform("oa_locations", lambda x: F.coalesce(x["url_for_pdf"], x["url"])), lambda x: x.isNotNull())
    return F.coalesce("best_oa_location.url_for_pdf", "best_oa_location.url", F.get(links, F.lit(0)))


def components(records: DataFrame, min_title: int = 0) -> DataFrame:
    """record_id and work: the least record_id that equal DOIs or equal titles lead to, over any number of steps.

    Null and blank keys link nothing. Each record is linked to the least record of its DOI and of its title, aggregates that are combined
    map-side; the graph of these links is then contracted, so a long chain of keys takes few rounds.
    """
    title = F.when(F.length(strip(F.col("title"))) > min_title, strip(F.col("title")))
    rows = save(records.select("record_id", bare_doi(F.col("doi")).alias("d"), title.alias("t")))
    edges = None
    for key in ("d", "t"):
        held = rows.where(F.col(key).isNotNull()).select(key, F.col("record_id").alias("b"))
        links = held.join(held.groupBy(key).agg(F.min("b").alias("a"), F.count("*").alias("n")).where("n > 1"), key).select("a", "b")
        edges = links if edges is None else edges.unionByName(links)
    roots = smallest_reachable(edges).withColumnRenamed("node", "record_id")
    return rows.select("record_id").join(roots, "record_id", "left").select("record_id", F.coalesce("root", "record_id").alias("work"))


def dedupe(records: DataFrame) -> DataFrame:
    """One row a work: the first non-null value of each field by record_id, the most citations, and the number of records."""
    works = components(records)
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("record_id"))).alias(c)
    return records.join(works, "record_id").groupBy("work").agg(*[first(c) for c in ("title", "year", "doi", "oa_url", "venue", "type")], F.max("citations").alias("citations"), F.count("*").alias("n_records"))


def verify(candidates: DataFrame, registry: DataFrame) -> DataFrame:
    """record_id and verified: whether the registry (doi) knows the candidate's DOI."""
    known = registry.select(bare_doi(F.col("doi")).alias("d"), F.lit(True).alias("known")).where("d IS NOT NULL").distinct()
    return candidates.withColumn("d", bare_doi(F.col("doi"))).join(known, "d", "left").select("record_id", F.coalesce("known", F.lit(False)).alias("verified"))


def held_status(candidates: DataFrame, library: DataFrame, catalog: DataFrame) -> DataFrame:
    """record_id and status: ``processed`` (in the library), ``downloaded``, ``listed`` (in the catalogue) or ``new``, by title."""
    lib = library.select("title", F.lit(True).alias("in_lib")).distinct()
    cat = catalog.groupBy("title").agg(F.bool_or("downloaded").alias("got"))
    both = candidates.join(lib, "title", "left").join(cat, "title", "left")
    return both.select("record_id", F.when(F.col("in_lib"), "processed").when(F.col("got"), "downloaded").when(F.col("got").isNotNull(), "listed").otherwise("new").alias("status"))


def quality(candidates: DataFrame, venues: DataFrame, scholars: DataFrame) -> DataFrame:
    """record_id, core_journal, known_press, core_scholar, citations, citation_source.

    venues: name, kind (``journal`` or ``press``); scholars: name. Both are joined by equality, authors one by one.
    """
    kinds = venues.groupBy(F.col("name").alias("venue")).agg(F.bool_or(F.col("kind") == "journal").alias("j"), F.bool_or(F.col("kind") == "press").alias("p"))
    core = candidates.select("record_id", F.explode("authors").alias("name")).join(scholars.select("name").distinct(), "name", "left_semi").select("record_id", F.lit(True).alias("s")).distinct()
    both = candidates.join(kinds, "venue", "left").join(core, "record_id", "left")
    no = lambda c: F.coalesce(F.col(c), F.lit(False))
    return both.select("record_id", no("j").alias("core_journal"), no("p").alias("known_press"), no("s").alias("core_scholar"), F.coalesce("citations", F.lit(0)).cast("bigint").alias("citations"), F.when(F.col("citations").isNotNull(), F.col("provider")).alias("citation_source"))


def oa_link(candidates: DataFrame) -> DataFrame:
    """doi, oa_url, link_source: the open link of a DOI, by provider in fixed order."""
    # fixed values: the order of trust
    rank = F.array_position(F.array(*map(F.lit, ("unpaywall", "semantic_scholar", "openalex"))), F.col("provider"))
    usable = candidates.withColumn("doi", bare_doi(F.col("doi"))).where("doi IS NOT NULL AND oa_url IS NOT NULL").withColumn("rank", rank).where("rank > 0")
    best = usable.groupBy("doi").agg(F.min(F.struct("rank", "record_id", "oa_url", "provider")).alias("b"))
    return best.select("doi", F.col("b.oa_url").alias("oa_url"), F.col("b.provider").alias("link_source"))


def best_format(offers: DataFrame) -> DataFrame:
    """work, format, better: of offers (work, kind, format, url) the best format: EPUB, HTML, PDF for books, HTML, PDF for papers.

    ``better`` is false if only a PDF is offered.
    """
    wanted = F.when(F.col("kind") == "book", F.array(F.lit("epub"), F.lit("html"), F.lit("pdf"))).otherwise(F.array(F.lit("html"), F.lit("pdf")))
    ranked = offers.withColumn("rank", F.array_position(wanted, F.lower("format"))).where("rank > 0")
    best = ranked.groupBy("work").agg(F.min(F.struct("rank", F.lower("format").alias("format"))).alias("b"))
    return best.select("work", F.col("b.format").alias("format"), (F.col("b.format") != "pdf").alias("better"))


def canonical_name(works: DataFrame, most: int = 80) -> DataFrame:
    """work and file_name of works (work, title, subtitle, people, ext): ``title-people.ext`` without forbidden characters.

    Colons become full-width; a subtitle that makes the name longer than ``most`` is dropped.
    """
    clean = lambda c: strip(F.regexp_replace(F.regexp_replace(c, r"\s*:\s*", "："), r'[/\\*?"<>|]', ""))
    title, whole = clean(F.col("title")), clean(F.concat_ws(": ", "title", "subtitle"))
    name = lambda t: F.concat(t, F.lit("-"), clean(F.array_join("people", " ")), F.lit("."), F.col("ext"))
    return works.select("work", F.when(F.length(name(whole)) > most, name(title)).otherwise(name(whole)).alias("file_name"))


def upsert_catalog(old: DataFrame, new: DataFrame) -> DataFrame:
    """The catalogue after an update: rows of ``new`` replace those of the same title, field by field where they aren't null."""
    fields = [c for c in old.columns if c != "title"]
    both = old.alias("o").join(new.alias("n"), "title", "full_outer")
    return both.select("title", *[F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) for c in fields])


def catalog_summary(catalog: DataFrame) -> DataFrame:
    """origin, format, n, n_done, n_waiting with subtotals by origin, by format and in all (nulls)."""
    done = F.coalesce("downloaded", F.lit(False))
    return catalog.groupingSets([["origin", "format"], ["origin"], ["format"], []], "origin", "format").agg(F.count("*").alias("n"), F.count_if(done).alias("n_done"), F.count_if(~done).alias("n_waiting"))


def top_candidates(candidates: DataFrame, k: int = 10) -> DataFrame:
    """topic, rank, record_id, citations: the ``k`` most cited of each topic."""
    w = Window.partitionBy("topic").orderBy(F.desc_nulls_last("citations"), "record_id")
    return candidates.withColumn("rank", F.row_number().over(w).cast("int")).where(F.col("rank") <= k).select("topic", "rank", "record_id", "citations")
