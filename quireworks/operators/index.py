"""Descriptions, the two-level index and retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quireworks.functions import carry
from quireworks.functions.lineage import hinted, save, save_bucketed
from quireworks.functions.text import heading_level, heading_text, is_blank, strip, terms_of

BLOCK = r"^chunk-(\d+)\.md:\s*(.+)$"
TAGS = r"^(?i:tags):\s*(.*)$"


def parse_descriptions(lines: DataFrame) -> DataFrame:
    """doc_id, chunk_no, main, subtopics, tags, part of (doc_id, part, line_no, line); later parts, and later blocks of a part, win."""
    line = F.col("line")
    w = Window.partitionBy("doc_id", "part").orderBy("line_no")
    opens = line.rlike(BLOCK)
    blocks = lines.withColumn("block", F.sum(opens.cast("int")).over(w)).where("block > 0").where(~is_blank(line))
    row, tagged = F.struct("line_no", strip(line).alias("v")), strip(line).rlike(TAGS)
    inner = lambda c: F.transform(F.sort_array(F.collect_list(F.when(c, row))), lambda x: x["v"])
    built = blocks.groupBy("doc_id", "part", "block").agg(F.max(F.when(opens, F.regexp_extract(line, BLOCK, 1).cast("int"))).alias("chunk_no"), F.max(F.when(opens, strip(F.regexp_extract(line, BLOCK, 2)))).alias("main"), inner(~opens & ~tagged).alias("subtopics"), F.element_at(F.concat(inner(~opens & tagged), F.array(F.lit("Tags:"))), 1).alias("t"))
    tags = F.filter(F.transform(F.split(F.regexp_extract("t", TAGS, 1), ","), lambda x: strip(x)), lambda x: x != "")
    newest = F.row_number().over(Window.partitionBy("doc_id", "chunk_no").orderBy(F.desc("part"), F.desc("block")))
    return built.withColumn("r", newest).where("r = 1").select("doc_id", "chunk_no", "main", "subtopics", tags.alias("tags"), "part")


def headings_of(lines: DataFrame) -> DataFrame:
    """doc_id, line_no, level, heading."""
    return lines.select("doc_id", "line_no", heading_level(F.col("line")).alias("level"), heading_text(F.col("line")).alias("heading")).where("level IS NOT NULL")


def chapter_headings(headings: DataFrame, chunks: DataFrame) -> DataFrame:
    """doc_id, line_no, heading: the headings of the least level found from the first chunk on."""
    first = chunks.groupBy("doc_id").agg(F.min("start").alias("first"))
    later = headings.join(first, "doc_id").where("line_no >= first")
    return later.withColumn("top", F.min("level").over(Window.partitionBy("doc_id"))).where("level = top").select("doc_id", "line_no", "heading")


def map_chapters(chunks: DataFrame, chapters: DataFrame, block: int = carry.BLOCK) -> DataFrame:
    """doc_id, chunk_no, start, chapter: the last chapter at or before the chunk, else the first one, else the chunk's own heading.

    An as-of join without a range: both sides together by line, chapters first at equal lines, the last chapter carried on.
    """
    chapters = save(chapters)
    a = chapters.select("doc_id", F.col("line_no").alias("at"), F.lit(0).alias("side"), F.col("heading").alias("chapter"), F.lit(None).cast("int").alias("chunk_no"), F.lit(None).cast("string").alias("own"))
    b = chunks.select("doc_id", F.col("start").alias("at"), F.lit(1).alias("side"), F.lit(None).cast("string").alias("chapter"), "chunk_no", F.col("heading").alias("own"))
    first = chapters.groupBy("doc_id").agg(F.min_by("heading", "line_no").alias("one"))
    both = carry.carried(a.unionByName(b), F.col("chapter"), "last", ("at", "side", "chunk_no"), block=block).where("side = 1").join(first, "doc_id", "left")
    return both.select("doc_id", "chunk_no", F.col("at").alias("start"), F.coalesce("last", "one", "own").alias("chapter"))


def chapter_groups(mapped: DataFrame) -> DataFrame:
    """doc_id, group_no, chapter, first_chunk, last_chunk of neighbouring chunks with equal chapter."""
    w = Window.partitionBy("doc_id").orderBy("chunk_no")
    starts = (~F.lag("chapter").over(w).eqNullSafe(F.col("chapter")) | (F.row_number().over(w) == 1)).cast("int")
    return mapped.withColumn("s", starts).withColumn("group_no", F.sum("s").over(w).cast("int")).groupBy("doc_id", "group_no").agg(F.first("chapter").alias("chapter"), F.min("chunk_no").alias("first_chunk"), F.max("chunk_no").alias("last_chunk"))


def index_gaps(chunks: DataFrame, descriptions: DataFrame) -> DataFrame:
    """doc_id, chunk_no, problem: ``missing`` (planned, not described) or ``extra``."""
    a, b = chunks.select("doc_id", "chunk_no", F.lit(1).alias("p")), descriptions.select("doc_id", "chunk_no", F.lit(1).alias("d")).distinct()
    both = a.join(b, ["doc_id", "chunk_no"], "full_outer").where("p IS NULL OR d IS NULL")
    return both.select("doc_id", "chunk_no", F.when(F.col("d").isNull(), "missing").otherwise("extra").alias("problem"))


def doc_meta(lines: DataFrame, section: str = "引用信息") -> DataFrame:
    """doc_id, title (first level-1 line), citation (the lines of the section named ``section``, or a placeholder).

    Lines are read several times; only those of documents that have such a section go through the window.
    """
    line = F.col("line")
    w = Window.partitionBy("doc_id").orderBy("line_no")
    opens = strip(line) == f"## {section}"
    having = save(lines.where(opens).select(F.col("doc_id").alias("d")).distinct())
    state = F.when(opens, 1).when(line.startswith("## "), 0)
    told = lines.join(hinted(having, having.count()), F.col("doc_id").eqNullSafe(F.col("d")), "left_semi").select("doc_id", "line_no", state.alias("state"), strip(line).alias("v")).where("state IS NOT NULL OR v != ''")
    cited = told.withColumn("inside", F.last("state", True).over(w)).where("inside = 1 AND state IS NULL")
    citations = cited.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "v"))), lambda x: x["v"]), "\n").alias("c"))
    titles = lines.where(line.startswith("# ")).groupBy("doc_id").agg(F.min_by(strip(F.substr(line, F.lit(3))), "line_no").alias("title"))
    rows = lines.select("doc_id").distinct().unionByName(titles, True).unionByName(citations, True).groupBy("doc_id").agg(F.max("title").alias("title"), F.max("c").alias("c"))
    return rows.select("doc_id", F.coalesce("title", F.lit("未知文献")).alias("title"), F.when(F.col("c") != "", F.col("c")).otherwise("[引用信息待补充]").alias("citation"))


def render_index(groups: DataFrame, described: DataFrame, meta: DataFrame) -> DataFrame:
    """doc_id and index_text: title, citation, and each group's heading with its chunks' lines, in order.

    groups: doc_id, group_no, chapter, first_chunk, last_chunk. described: doc_id, chunk_no, main. meta: doc_id, title, citation.
    """
    heads = groups.select("doc_id", F.col("first_chunk").alias("n"), F.lit(0).alias("k"), F.concat(F.lit("\n## "), "chapter", F.lit("\n")).alias("row"))
    items = described.select("doc_id", F.col("chunk_no").alias("n"), F.lit(1).alias("k"), F.concat(F.lit("- **chunk-"), F.lpad(F.col("chunk_no").cast("string"), F.greatest(F.lit(2), F.length(F.col("chunk_no").cast("string"))), F.lit("0")), F.lit(".md**: "), "main").alias("row"))
    body = heads.unionByName(items).groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "k", "row"))), lambda x: x["row"]), "\n").alias("body"))
    return meta.join(body, "doc_id").select("doc_id", F.concat(F.lit("# "), "title", F.lit("\n\n"), "citation", F.lit("\n"), "body").alias("index_text"))


def pending_descriptions(chunks: DataFrame, done: DataFrame) -> DataFrame:
    """doc_id, chunk_no of the chunks not described yet."""
    return chunks.select("doc_id", "chunk_no").join(done.select("doc_id", "chunk_no"), ["doc_id", "chunk_no"], "left_anti")


def assign_batches(pending: DataFrame, most: int = 35) -> DataFrame:
    """doc_id, chunk_no, batch_no: neighbouring chunks in even batches of at most ``most``."""
    w = Window.partitionBy("doc_id")
    numbered = pending.withColumns({"i": F.row_number().over(w.orderBy("chunk_no")), "n": F.count("*").over(w)})
    batches = F.ceil(F.col("n") / most)
    return numbered.select("doc_id", "chunk_no", F.ceil(F.col("i") * batches / F.col("n")).cast("int").alias("batch_no"))


def check_descriptions(descriptions: DataFrame, lexicon: DataFrame) -> DataFrame:
    """doc_id, chunk_no, rule: subtopics not 2 to 4 or longer than 20, tags not 3 to 6, no section mark or verb, or position alone.

    lexicon: kind (``mark`` or ``banned``) and phrase; a small table that is gathered into two arrays.
    """
    words = lexicon.agg(F.collect_set(F.when(F.col("kind") == "mark", F.col("phrase"))).alias("marks"), F.collect_set(F.when(F.col("kind") == "banned", F.col("phrase"))).alias("banned"))
    d = descriptions.withColumns({"marks": words.select("marks").scalar(), "banned": words.select("banned").scalar()})
    main = F.col("main")
    rules = {
        "subtopic-count": ~F.size("subtopics").between(2, 4),
        "subtopic-length": F.exists("subtopics", lambda s: F.length(s) > 20),
        "tag-count": ~F.size("tags").between(3, 6),
        "no-mark": ~F.exists(F.coalesce("marks", F.array().cast("array<string>")), lambda m: main.contains(m)),
        "position-only": F.exists(F.coalesce("banned", F.array().cast("array<string>")), lambda m: main.contains(m)),
    }
    hits = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in rules.items()]), lambda x: x.isNotNull())
    return d.select("doc_id", "chunk_no", F.explode(hits).alias("rule"))


def library_index(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """doc_id, title, type_tag, n_chunks, pointer for docs (doc_id, title, type_tag)."""
    n = chunks.groupBy("doc_id").agg(F.count("*").alias("n_chunks"))
    return docs.join(n, "doc_id", "left").select("doc_id", "title", "type_tag", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), F.concat(F.lit("library/"), F.col("doc_id").cast("string"), F.lit("/index.md")).alias("pointer"))


def tag_stats(descriptions: DataFrame, k: int = 3) -> DataFrame:
    """doc_id, tag, n, df, rank: each document's ``k`` commonest tags, with the number of documents that have the tag."""
    tags = descriptions.select("doc_id", F.explode("tags").alias("tag"))
    n = tags.groupBy("doc_id", "tag").agg(F.count("*").alias("n"))
    df = n.groupBy("tag").agg(F.count("*").alias("df"))
    w = Window.partitionBy("doc_id").orderBy(F.desc("n"), "tag")
    return n.withColumn("rank", F.row_number().over(w).cast("int")).where(F.col("rank") <= k).join(df, "tag").select("doc_id", "tag", "n", "df", "rank")


def retrieve(queries: DataFrame, descriptions: DataFrame, k: int = 5, most_share: float = 1.0, by_rarity: bool = False, common: float = 0.05) -> DataFrame:
    """query_id, rank, doc_id, chunk_no, score: the ``k`` chunks whose main line, subtopics and tags share most terms with the query; with ``by_rarity`` a term counts
    one more for each halving of the share of chunks that have it. Terms in more than ``most_share`` of the chunks are left out.

    Only postings of queried terms are kept, dealt out by document once, so that a chunk's scores are added up where its postings are. Rare terms are scored first; their k-th best score is a bound that what enters must reach. Where it is more than all
    of a query's common terms (in more than ``common`` of the chunks) can add up to, chunks with common terms alone are out, and common terms are counted for those chunks alone
    that can still reach the bound. Other queries are scored in full. Spark keeps a query's first ``k`` of each task before it ranks them, so no task takes a
    query's whole list. Ties go to smaller ids; chunks without ids take no part.
    """
    said = F.concat_ws(" ", "main", F.array_join("subtopics", " "), F.array_join("tags", " "))
    ids = ["query_id", "doc_id", "chunk_no"]
    asked = save(queries.select("query_id", F.explode(terms_of(F.col("text"))).alias("term")).distinct())
    wanted = asked.select("term").distinct()
    described = descriptions.where("doc_id IS NOT NULL AND chunk_no IS NOT NULL")
    said_terms = described.select("doc_id", "chunk_no", F.explode(terms_of(said)).alias("term")).join(hinted(wanted, wanted.count()), "term", "left_semi")
    postings = save_bucketed(said_terms.select("doc_id", "chunk_no", "term"), "doc_id").distinct()
    total = described.count()
    n = postings.groupBy("term").agg(F.count("*").alias("n"))
    weight = F.length(F.bin(F.floor(F.lit(total) / F.col("n")))) if by_rarity else F.lit(1)
    weighted = save(asked.join(n.where(F.col("n") <= most_share * total), "term").select("query_id", "term", weight.cast("bigint").alias("weight"), (F.col("n") > common * total).alias("common")))
    n_weighted = weighted.count()

    def scored(terms: DataFrame) -> DataFrame:
        return postings.join(hinted(terms, n_weighted), "term")

    def first(scores: DataFrame) -> DataFrame:
        w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id", "chunk_no")
        return scores.withColumn("rank", F.row_number().over(w).cast("int")).where(F.col("rank") <= k)

    rare = save(scored(weighted.where("NOT common")).groupBy(*ids).agg(F.sum("weight").alias("score")))
    bound = first(rare).groupBy("query_id").agg(F.count("*").alias("found"), F.min("score").alias("bound"))
    rest = weighted.groupBy("query_id").agg(F.sum(F.when(F.col("common"), F.col("weight")).otherwise(0)).alias("rest"))
    bounded = save(rest.join(bound, "query_id", "left").withColumn("sure", (F.col("rest") == 0) | (F.coalesce("found", F.lit(0)) == k) & (F.col("rest") < F.col("bound"))))
    n_queries = bounded.count()
    sure, unsure = hinted(bounded.where("sure"), n_queries), hinted(bounded.where("NOT sure").select("query_id"), n_queries)
    able = save_bucketed(rare.join(sure, "query_id").where(F.col("score") + F.col("rest") >= F.coalesce("bound", F.lit(0))).select(*ids, "score"), "doc_id")
    # from the pairs that are left to their chunks' terms: all common terms with all their queries would be many times as many
    more = able.select(*ids).join(postings, ["doc_id", "chunk_no"]).join(hinted(weighted.where("common").select("query_id", "term", "weight"), n_weighted), ["query_id", "term"]).select(*ids, "weight")
    added = able.unionByName(more.withColumnRenamed("weight", "score")).groupBy(*ids).agg(F.sum("score").alias("score"))
    in_full = scored(weighted.join(unsure, "query_id", "left_semi")).groupBy(*ids).agg(F.sum("weight").alias("score"))
    return first(added.unionByName(in_full)).select("query_id", "rank", "doc_id", "chunk_no", "score")
