"""Notes: links and their targets, names, sentences, citations and small text forms, over a view of notes.

The tables hold no Markdown, so a note is written for every customer from its row, its nation and its orders' priorities;
the SQL writes the same note.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.operators import facts, markdown
from lodestar.registry import query, table

_TEXT = """'# Report of ' || n_name || chr(10) || 'Dr. Alan met Mr. ' || n_name || ' in [[places/nation-' || n_nationkey || '#history|' || n_name || ']]. They spoke. "Quiet words" were said! Was it v2Plan or XML9? See [the card](customers/c' || c_custkey % 40 || '.md#top), [[alias ' || c_custkey % 7 || ']] and [web](https://example.com/x). Code: `[[no link]] #notag` ends.' || chr(10) || 'It cost $' || c_custkey % 90 || '.50 or ' || c_custkey % 9 || ' %. [Source: Ledger ' || c_custkey % 3 || ', 2024-01-' || CASE WHEN c_custkey % 5 = 0 THEN '99' ELSE '17' END || '] #market/' || lower(c_mktsegment) || ' token sk-abcdefabcdef' || (100000 + c_custkey % 1000) || CASE WHEN c_custkey % 3 = 0 THEN ' 東京都の駅 그' ELSE '' END"""
_SPARK_TEXT = _TEXT.replace("chr(10)", "'\\n'")
_NOTES = f"notes AS (SELECT c_custkey AS note, {_TEXT} AS text FROM customer JOIN nation ON c_nationkey = n_nationkey), "
_TARGETS = """targets AS (SELECT n_nationkey AS doc, 'places/nation-' || n_nationkey || '.md' AS path, ['Nation ' || n_nationkey, 'alias ' || n_nationkey % 9] AS aliases FROM nation
    UNION ALL SELECT c_custkey + 1000, 'customers/c' || c_custkey || '.md', ['Card ' || c_custkey] FROM customer WHERE c_custkey < 30
    UNION ALL SELECT 900, 'misc/Alias 3.md', ['other']), """


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(note, text): a Markdown note for each customer; nations are few and joined by their key."""
    nation = table(spark, sf_dir, "nation")
    return table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("note"), F.expr(_SPARK_TEXT).alias("text"))


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc, path, aliases) of notes that links can name."""
    nation = table(spark, sf_dir, "nation").selectExpr("n_nationkey AS doc", "'places/nation-' || n_nationkey || '.md' AS path", "array('Nation ' || n_nationkey, 'alias ' || n_nationkey % 9) AS aliases")
    cards = table(spark, sf_dir, "customer").where("c_custkey < 30").selectExpr("c_custkey + 1000 AS doc", "'customers/c' || c_custkey || '.md' AS path", "array('Card ' || c_custkey) AS aliases")
    return nation.unionByName(cards).unionByName(spark.range(1).selectExpr("900L AS doc", "'misc/Alias 3.md' AS path", "array('other') AS aliases"))


_CLEAN = "clean AS (SELECT note, regexp_replace(text, '`[^`\n]*`', ' ', 'g') AS t FROM notes), "
_LINKS = (
    _CLEAN
    + r"""l AS (SELECT note, unnest(list_transform(regexp_extract_all(t, '\[\[([^\[\]\n]+)\]\]', 1), lambda x: {'kind': 'wikilink', 'target': trim(regexp_extract(x, '^([^|#^]*)', 1)), 'label': trim(regexp_extract(x, '([^|]*)$', 1))})) AS l FROM clean
    UNION ALL SELECT note, unnest(list_transform(list_filter(list_zip(regexp_extract_all(t, '\[([^\[\]\n]*)\]\(([^()\s]+)\)', 2), regexp_extract_all(t, '\[([^\[\]\n]*)\]\(([^()\s]+)\)', 1)), lambda x: NOT regexp_matches(x[1], '^(?:[a-zA-Z][a-zA-Z0-9+.-]*:|//|#)')), lambda x: {'kind': 'markdown', 'target': regexp_replace(x[1], '#.*$', ''), 'label': x[2]})) FROM clean
    UNION ALL SELECT note, unnest(list_transform(regexp_extract_all(t, '(?:^|\s)#([\p{L}\p{N}_/-]*[\p{L}_][\p{L}\p{N}_/-]*)', 1), lambda x: {'kind': 'tag', 'target': x, 'label': x})) FROM clean),
    links AS (SELECT DISTINCT note, l.kind AS kind, l.target AS target, l.label AS label FROM l WHERE l.target <> ''), """
)


@query("note_links", f"WITH {_NOTES} {_LINKS} x AS (SELECT 1) SELECT note, kind, target, label FROM links")
def note_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All links of all notes."""
    return notes(spark, sf_dir).select("note", F.explode(markdown.links(F.col("text"))).alias("l")).select("note", "l.*")


@query(
    "link_targets",
    f"""WITH {_NOTES} {_LINKS} {_TARGETS}
    p AS (SELECT regexp_replace(path, '\\.md$', '') AS wanted, min(doc) AS by_path FROM targets GROUP BY 1),
    a AS (SELECT lower(trim(a)) AS k, arg_min(doc, path) AS by_alias FROM (SELECT doc, path, unnest(aliases) AS a FROM targets) GROUP BY 1),
    leaf AS (SELECT DISTINCT lower(regexp_replace(string_split(path, '/')[-1], '\\.md$', '')) AS k FROM targets),
    j AS (SELECT note AS source, kind, target, label, by_path, CASE WHEN kind = 'wikilink' AND NOT contains(target, '/') AND leaf.k IS NULL THEN by_alias END AS by_alias FROM links
      LEFT JOIN p ON kind <> 'tag' AND p.wanted = regexp_replace(target, '\\.md$', '') LEFT JOIN a ON a.k = lower(trim(target)) LEFT JOIN leaf ON leaf.k = lower(trim(target)))
    SELECT source, kind, target, label, coalesce(by_path, by_alias) AS doc, CASE WHEN by_path IS NOT NULL THEN 'path' WHEN by_alias IS NOT NULL THEN 'alias' ELSE 'none' END AS how FROM j""",
)
def link_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The note that each link names: by its path, else by an alias."""
    return markdown.resolve_links(note_links(spark, sf_dir).withColumnRenamed("note", "source"), targets(spark, sf_dir))


@query(
    "wikilink_parts",
    f"""WITH {_NOTES} {_CLEAN} w AS (SELECT note, unnest(regexp_extract_all(t, '\\[\\[([^\\[\\]\n]+)\\]\\]', 1)) AS x FROM clean)
    SELECT note, nullif(trim(regexp_extract(x, '^([^|#^]*)', 1)), '') AS target, nullif(trim(regexp_extract(x, '#([^|#^]*)', 1)), '') AS anchor, nullif(trim(regexp_extract(x, '\\^([^|#^]*)', 1)), '') AS block, nullif(trim(regexp_extract(x, '\\|(.*)$', 1)), '') AS alias FROM w""",
)
def wikilink_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    inner = F.regexp_extract_all(markdown.without_code(F.col("text")), F.lit(markdown.WIKILINK), F.lit(1))
    return notes(spark, sf_dir).select("note", F.explode(F.transform(inner, markdown.wikilink_parts)).alias("w")).select("note", "w.*")


_ENTITIES = r"""list_distinct(list_filter(list_transform(list_concat(regexp_extract_all({t}, '\p{{Lu}}[\p{{Ll}}\p{{N}}]+(?: \p{{Lu}}[\p{{Ll}}\p{{N}}]+)+'), regexp_extract_all({t}, '"([^"\n]{{2,80}})"', 1),
    list_filter(regexp_extract_all({t}, '[\p{{L}}\p{{N}}]+'), lambda w: regexp_full_match(w, '(?:\p{{Lu}}[\p{{Ll}}\p{{N}}]+|\p{{Ll}}+\p{{Lu}}[\p{{L}}\p{{N}}]*|\p{{Lu}}{{2,}}\p{{N}}*|\p{{L}}+\p{{N}}+)'))), lambda x: lower(trim(x))), lambda x: length(x) >= 2))"""


@query("note_entities", f"WITH {_NOTES} e AS (SELECT note, unnest({_ENTITIES.format(t='text')}) AS entity FROM notes) SELECT note, entity FROM e")
def note_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes(spark, sf_dir).select("note", F.explode(markdown.entities(F.col("text"))).alias("entity"))


@query(
    "entity_join",
    f"""WITH q AS (SELECT item_id AS query, unnest({_ENTITIES.format(t="coalesce(text, '')")}) AS entity FROM benchmark), d AS (SELECT doc_id AS doc, unnest({_ENTITIES.format(t="coalesce(text, '')")}) AS entity FROM documents),
    df AS (SELECT entity FROM d GROUP BY entity HAVING count(*) <= 50), found AS (SELECT query, doc, count(*) AS shared FROM q JOIN df USING (entity) JOIN d USING (entity) GROUP BY ALL)
    SELECT query, doc, shared FROM found QUALIFY row_number() OVER (PARTITION BY query ORDER BY shared DESC, doc) <= 10""",
)
def entity_join(spark: SparkSession, sf_dir: str, most: int = 50, k: int = 10) -> DataFrame:
    """The k documents that share most names with each query; a name that over `most` documents have tells nothing and is left out."""
    names = lambda df, key, alias: df.select(F.col(key).alias(alias), F.explode(markdown.entities(F.col("text"))).alias("entity"))
    asked = names(table(spark, sf_dir, "benchmark"), "item_id", "query")
    held = names(table(spark, sf_dir, "documents"), "doc_id", "doc").join(asked.select("entity").distinct(), "entity", "left_semi")
    rare = held.groupBy("entity").agg(F.count("*").alias("df")).where(F.col("df") <= most).select("entity")
    found = asked.join(rare, "entity").join(held, "entity").groupBy("query", "doc").agg(F.count("*").alias("shared"))
    from lodestar.operators.lexical import top

    return top(found, "query", "shared", "doc", k).drop("rank")


def sentences_sql(text: str) -> str:
    """The sentences of a text in SQL without lookaround: stops of abbreviations and initials stand aside while it is cut."""
    known = "|".join(a.replace(".", r"\.") for a in markdown.ABBREVIATIONS)
    space = markdown.SPACE
    for _ in range(2):  # one stop's white space may be the next one's begin
        for word in (rf"(?i:{known})\.?", "[A-Za-z]"):
            text = rf"regexp_replace({text}, '(^|[{space}])({word})\.([{space}])', '\1\2' || chr(2) || '\3', 'g')"
    cut = rf"regexp_replace({text}, '([.!?])[{space}]+([A-Z0-9\"''(\[])', '\1' || chr(1) || '\2', 'g')"
    return rf"list_filter(list_transform(string_split(replace({cut}, chr(2), '.'), chr(1)), lambda x: regexp_replace(x, '^[{space}]+|[{space}]+$', '', 'g')), lambda x: x <> '')"


@query("note_sentences", f"WITH {_NOTES} s AS (SELECT note, {sentences_sql('text')} AS s FROM notes) SELECT note, generate_subscripts(s, 1) AS n, unnest(s) AS sentence FROM s")
def note_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = notes(spark, sf_dir).select("note", F.posexplode(markdown.sentences(F.col("text"))).alias("n", "sentence"))
    return rows.select("note", (F.col("n") + 1).cast("long").alias("n"), "sentence")


@query(
    "note_citations",
    rf"""WITH {_NOTES} c AS (SELECT note, unnest(list_zip(regexp_extract_all(text, '\[Source: ([^,\]\n]+), (\d{{4}}-\d{{2}}-\d{{2}})\]', 1), regexp_extract_all(text, '\[Source: ([^,\]\n]+), (\d{{4}}-\d{{2}}-\d{{2}})\]', 2))) AS c FROM notes)
    SELECT note, trim(c[1]) AS name, TRY_CAST(c[2] AS DATE) AS day FROM c""",
)
def note_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes(spark, sf_dir).select("note", F.explode(markdown.citations(F.col("text"))).alias("c")).select("note", "c.*")


@query(
    "note_quantities",
    rf"""WITH {_NOTES} x AS (SELECT 1) SELECT note, CAST(regexp_extract(text, '[$€£]([0-9]+(?:\.[0-9]+)?)', 1) AS DOUBLE) AS value, 'USD' AS unit FROM notes""",
)
def note_quantities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes(spark, sf_dir).select("note", markdown.quantity(F.col("text")).alias("q")).select("note", "q.*")


@query(
    "note_slugs",
    rf"""WITH {_NOTES} x AS (SELECT 1) SELECT note, regexp_replace(substr(regexp_replace(regexp_replace(lower(string_split(text, chr(10))[1]), '[^\p{{L}}\p{{N}}]+', '-', 'g'), '^-|-$', '', 'g'), 1, 12), '-$', '') AS slug, regexp_replace(text, 'sk-[A-Za-z0-9_-]{{16,}}', '[redacted]', 'g') AS redacted,
    length(regexp_extract(substr(text, 1, 90), '(?s)^(.*[.!?])(?:\s|$)', 1)) AS clipped FROM notes""",
)
def note_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A slug of each note's first line, the text without secrets, and the length of a clip of 90 characters."""
    first = F.element_at(F.split("text", "\n"), 1)
    return notes(spark, sf_dir).select("note", markdown.slug(first, 12).alias("slug"), markdown.redacted(F.col("text")).alias("redacted"), F.length(markdown.clipped(F.col("text"), 90)).cast("long").alias("clipped"))


@query(
    "cjk_tokens",
    f"WITH {_NOTES} x AS (SELECT 1) SELECT note, unnest(['東京', '京都', 'の', '駅', '그']) AS token FROM notes WHERE contains(text, '東京都')",
)
def cjk_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes(spark, sf_dir).select("note", F.explode(markdown.cjk_bigrams(F.col("text"))).alias("token"))


@query(
    "numbered_lines",
    f"""WITH {_NOTES} l AS (SELECT note, string_split(text, chr(10)) AS l FROM notes) SELECT note, array_to_string(list_transform(l, lambda x, i: '[' || i || '] ' || x), chr(10)) AS numbered, 'note-' || note AS path, 2 AS first, 3 AS last FROM l""",
)
def numbered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes with line numbers, and a line pointer taken apart."""
    at = markdown.pointer(F.concat(F.lit("note-"), F.col("note").cast("string"), F.lit(":L2-L3")))
    return notes(spark, sf_dir).select("note", markdown.numbered_lines(F.col("text")).alias("numbered"), at.alias("p")).select("note", "numbered", "p.*")


# A Markdown record of every conversation: a heading a turn, its text, and in turn the text as a list item, a quote or code.
_PIECE = """repeat('#', CAST(1 + turn % 3 AS INT)) || ' ' || coalesce(role, 'none') || ' ' || turn || chr(10) || replace(coalesce(text, ''), ' the ', ' Dr. The ')
    || CASE turn % 4 WHEN 0 THEN chr(10) || chr(10) || '- ' || replace(replace(coalesce(text, ''), chr(10), ' '), ' and ', ' e.g. And ') WHEN 1 THEN chr(10) || '> ' || coalesce(text, '') WHEN 2 THEN chr(10) || '```' || chr(10) || coalesce(text, '') || chr(10) || '```' ELSE chr(10) || '  3) one `code` item of ' || coalesce(role, '') END"""
_RECORDS = f"records AS (SELECT conv_id, CASE WHEN conv_id % 3 = 0 THEN '---' || chr(10) || 'title: x' || chr(10) || '---' || chr(10) ELSE '' END || string_agg(piece, chr(10) ORDER BY turn, piece) AS text FROM (SELECT conv_id, turn, {_PIECE} AS piece FROM conversations) GROUP BY conv_id)"


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, text): the record of every conversation."""
    pieces = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.expr(_PIECE).alias("piece"))
    front = F.when(F.col("conv_id") % 3 == 0, "---\ntitle: x\n---\n").otherwise("")
    joined = pieces.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "piece"))).alias("p"))
    return joined.select("conv_id", F.concat(front, F.array_join(F.transform("p", lambda x: x["piece"]), "\n")).alias("text"))


_TRIM = f"'^[{markdown.SPACE}]+|[{markdown.SPACE}]+$', '', 'g'"


@query(
    "atomic_facts",
    rf"""WITH {_RECORDS},
    raw AS (SELECT conv_id, generate_subscripts(ls, 1) AS ln, unnest(ls) AS line FROM (SELECT conv_id, string_split_regex(text, '\r?\n') AS ls FROM records)),
    l0 AS (SELECT *, regexp_replace(line, {_TRIM}) AS body FROM raw),
    l1 AS (SELECT * FROM l0 WHERE NOT (conv_id % 3 = 0 AND ln <= 3)),
    l2 AS (SELECT *, count(*) FILTER (WHERE starts_with(body, '```') OR starts_with(body, '~~~')) OVER (PARTITION BY conv_id ORDER BY ln) AS fences FROM l1),
    l3 AS (SELECT *, CASE WHEN starts_with(body, '```') OR starts_with(body, '~~~') THEN 'fence' WHEN fences % 2 = 1 THEN 'code' WHEN body = '' THEN 'blank' WHEN starts_with(body, '>') THEN 'quote' WHEN regexp_matches(body, '^#{{1,6}}[{markdown.SPACE}]') THEN 'heading'
      WHEN regexp_matches(line, '^[{markdown.SPACE}]*([-*+]|[0-9]{{1,3}}[.)])[{markdown.SPACE}]+.') THEN 'item' ELSE 'prose' END AS kind FROM l2),
    heads AS (SELECT conv_id, ln, length(regexp_extract(body, '^#+')) AS level, trim(substr(regexp_replace(regexp_replace(body, '^#+[{markdown.SPACE}]+', ''), '[{markdown.SPACE}]+', ' ', 'g'), 1, 300)) AS title FROM l3 WHERE kind = 'heading'),
    ended AS (SELECT h.*, (SELECT min(o.ln) FROM heads o WHERE o.conv_id = h.conv_id AND o.ln > h.ln AND o.level <= h.level) AS until FROM heads h),
    l4 AS (SELECT *, count(*) FILTER (WHERE kind <> 'prose') OVER (PARTITION BY conv_id ORDER BY ln) AS paragraph FROM l3),
    blocks AS (SELECT conv_id, min(ln) AS ln, 'sentence' AS kind, string_agg(body, ' ' ORDER BY ln) AS t FROM l4 WHERE kind = 'prose' GROUP BY conv_id, paragraph
      UNION ALL SELECT conv_id, ln, 'list_item', regexp_extract(line, '^[{markdown.SPACE}]*(?:[-*+]|[0-9]{{1,3}}[.)])[{markdown.SPACE}]+(.+)$', 1) FROM l4 WHERE kind = 'item'),
    cut AS (SELECT conv_id, ln, kind, CASE WHEN kind = 'list_item' AND len(s) <= 1 THEN [t] ELSE s END AS s FROM (SELECT *, {sentences_sql('t')} AS s FROM blocks)),
    said AS (SELECT conv_id, ln, kind, generate_subscripts(s, 1) AS n, unnest(s) AS x FROM cut),
    stated AS (SELECT *, substr(trim(regexp_replace(regexp_replace(x, '`[^`\n]*`', ' ', 'g'), '[{markdown.SPACE}]+', ' ', 'g')), 1, 300) AS statement FROM said),
    paths AS (SELECT b.conv_id, b.ln, string_agg(title, ' > ' ORDER BY e.ln) AS headings FROM blocks b JOIN ended e ON e.conv_id = b.conv_id AND e.ln < b.ln AND (e.until IS NULL OR e.until > b.ln) GROUP BY ALL)
    SELECT s.conv_id, s.ln AS line, n, kind, coalesce(headings, '') AS headings, statement FROM stated s LEFT JOIN paths p ON p.conv_id = s.conv_id AND p.ln = s.ln WHERE length(statement) >= 15""",
)
def atomic_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the records of all conversations state, with the headings above."""
    found = facts.atomic_facts(records(spark, sf_dir), "conv_id", "text")
    return found.withColumn("headings", F.array_join("headings", " > "))


@query("document_sentences", f"WITH s AS (SELECT doc_id, {sentences_sql('text')} AS s FROM documents) SELECT doc_id, len(s) AS sentences, md5(array_to_string(s, '|')) AS digest, coalesce(list_max(list_transform(s, lambda x: length(x))), 0) AS longest FROM s WHERE len(s) > 0")
def document_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentences of every document that has any: their number, the longest, and all of them as a digest."""
    cut = table(spark, sf_dir, "documents").select("doc_id", markdown.sentences(F.col("text")).alias("s")).where(F.size("s") > 0)
    return cut.select("doc_id", F.size("s").cast("long").alias("sentences"), F.md5(F.array_join("s", "|").cast("binary")).alias("digest"), F.array_max(F.transform("s", F.length)).cast("long").alias("longest"))


_MARKED = """CASE o_orderkey % 8 WHEN 0 THEN 'see [Source: Ledger, part ' || o_custkey || ', 2024-02-29] and [Source: B,2023-02-29]' WHEN 1 THEN '[Source: X 2024-01-01]' WHEN 2 THEN '[Source:   ] none' || chr(10) || '[Source:Y  ,  2024-12-31 ]' WHEN 3 THEN '[Source: , 2024-01-01]'
    WHEN 4 THEN '[source: a, 2024-01-01]' WHEN 5 THEN 'x' || chr(13) || chr(10) || chr(10) || '[Source: ' || o_orderpriority || ', 2024-13-01][Source: Z, 24-01-01]' WHEN 6 THEN '[Source: open, 2024-01-01' ELSE '[Source: [n, 2024-01-01]' END"""


@query(
    "citation_marks",
    f"""WITH o AS (SELECT o_orderkey AS note, o_orderkey % 8 AS form, o_custkey AS c, o_orderpriority AS p FROM orders),
    marks AS (SELECT note, 1 AS line, '[Source: Ledger, part ' || c || ', 2024-02-29]' AS raw, 'Ledger, part ' || c AS name, DATE '2024-02-29' AS day, NULL AS reason FROM o WHERE form = 0 UNION ALL SELECT note, 1, '[Source: B,2023-02-29]', NULL, NULL, 'day' FROM o WHERE form = 0
      UNION ALL SELECT note, 1, '[Source: X 2024-01-01]', NULL, NULL, 'shape' FROM o WHERE form = 1 UNION ALL SELECT note, 1, '[Source:   ]', NULL, NULL, 'shape' FROM o WHERE form = 2 UNION ALL SELECT note, 2, '[Source:Y  ,  2024-12-31 ]', 'Y', DATE '2024-12-31', NULL FROM o WHERE form = 2
      UNION ALL SELECT note, 1, '[Source: , 2024-01-01]', NULL, NULL, 'shape' FROM o WHERE form = 3 UNION ALL SELECT note, 3, '[Source: ' || p || ', 2024-13-01]', NULL, NULL, 'day' FROM o WHERE form = 5 UNION ALL SELECT note, 3, '[Source: Z, 24-01-01]', NULL, NULL, 'shape' FROM o WHERE form = 5
      UNION ALL SELECT note, 1, '[Source: [n, 2024-01-01]', '[n', DATE '2024-01-01', NULL FROM o WHERE form = 7)
    SELECT note, line, raw, name, day, reason FROM marks""",
)
def citation_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All citation marks of a note on every order, malformed ones with the reason."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("note"), F.expr(_MARKED).alias("text"))
    return rows.select("note", F.explode(markdown.citation_marks(F.col("text"))).alias("m")).select("note", "m.*")
