"""Queries over the dataset tables and the DuckDB SQL that each is held against.

The tables hold no paged documents, so each query maps a table to the shape that
its operator takes; query and SQL use one mapping. See README for the list.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataleaf.functions import text as t
from strataleaf.operators import batching, correction, features, ocr, offsets, rename, serialize, toc, usage
from strataleaf.plans import duck as d
from strataleaf.plans import flows
from strataleaf.session import table
from strataleaf.sources import pages as source

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


# ---- Entries from line items: one document an order ----

LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate"]
ENTRIES_SQL = f"""entries AS (
  SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(LINE_ORDER)}) AS ordinal,
         l_returnflag || l_linestatus AS title, l_linenumber AS page_number, (l_quantity::INT % 5) AS level, l_discount * 10 AS confidence
  FROM lineitem)"""


def entries_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER)
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"),
        F.row_number().over(order).cast("long").alias("ordinal"),
        F.concat("l_returnflag", "l_linestatus").alias("title"),
        F.col("l_linenumber").alias("page_number"),
        (F.col("l_quantity").cast("int") % 5).alias("level"),
        (F.col("l_discount") * 10).alias("confidence"),
    )


@query(f"WITH {ENTRIES_SQL} SELECT * FROM entries QUALIFY row_number() OVER (PARTITION BY doc_id, page_number, title ORDER BY ordinal) = 1")
def toc_dedup(spark, sf_dir):
    return toc.deduplicate(entries_of(spark, sf_dir))


@query(f"WITH {ENTRIES_SQL} SELECT * REPLACE (row_number() OVER (PARTITION BY doc_id ORDER BY page_number, level, ordinal) AS ordinal) FROM entries")
def toc_sort(spark, sf_dir):
    return toc.sort_by_page(entries_of(spark, sf_dir))


SANITIZED = """SELECT * EXCLUDE (i, dd) REPLACE ((i + min(dd) OVER (PARTITION BY doc_id ORDER BY ordinal ROWS UNBOUNDED PRECEDING))::INT AS level) FROM (
  SELECT *, row_number() OVER w AS i, (CASE WHEN row_number() OVER w = 1 THEN 1 ELSE greatest(1, level) END) - row_number() OVER w AS dd
  FROM {0} WINDOW w AS (PARTITION BY doc_id ORDER BY ordinal))"""


@query(f"WITH {ENTRIES_SQL} {SANITIZED.format('entries')}")
def toc_sanitize_hierarchy(spark, sf_dir):
    return toc.sanitize_hierarchy(entries_of(spark, sf_dir))


@query(f"""WITH {ENTRIES_SQL},
b AS (SELECT *, 1 - ordinal % 2 AS batch_ix FROM entries),
k AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY doc_id, page_number, title ORDER BY batch_ix, ordinal) = 1)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY page_number, level, batch_ix, ordinal) AS ordinal, title, page_number, level, confidence FROM k""")
def toc_merge(spark, sf_dir):
    return toc.merge(entries_of(spark, sf_dir).withColumn("batch_ix", 1 - F.col("ordinal") % 2))


@query(f"""WITH {ENTRIES_SQL},
k AS (SELECT * FROM entries QUALIFY row_number() OVER (PARTITION BY doc_id, page_number, title ORDER BY ordinal) = 1),
s AS (SELECT * REPLACE (row_number() OVER (PARTITION BY doc_id ORDER BY page_number, level, ordinal) AS ordinal) FROM k)
{SANITIZED.format('s')}""")
def toc_finish(spark, sf_dir):
    return toc.finish(entries_of(spark, sf_dir))


@query(f"WITH {ENTRIES_SQL} SELECT doc_id, ordinal, level, title, page_number FROM entries")
def toc_to_rows(spark, sf_dir):
    return toc.to_rows(entries_of(spark, sf_dir))


@query(f"WITH {ENTRIES_SQL} SELECT doc_id, ordinal, title, page_number, level, 1.0::DOUBLE AS confidence FROM entries")
def toc_from_rows(spark, sf_dir):
    return toc.from_rows(toc.to_rows(entries_of(spark, sf_dir)))


@query(f"""WITH {ENTRIES_SQL}, c AS (SELECT *, round({d.round_exact('confidence', 2)} * 100)::BIGINT AS n FROM entries)
SELECT doc_id, ordinal, concat('- ', title, ' (page ', page_number, ', level ', level, ', confidence ', n // 100, '.', lpad((n % 100)::VARCHAR, 2, '0'), ')') AS bullet FROM c""")
def toc_bullets(spark, sf_dir):
    return entries_of(spark, sf_dir).select("doc_id", "ordinal", toc.entry_bullet().alias("bullet"))


@query(f"""WITH {ENTRIES_SQL} SELECT doc_id, ordinal, concat('TOCEntry(level=', level, ', title=''', title, ''', page_number=', page_number, ', confidence=', confidence::VARCHAR, ')') AS entry FROM entries""")
def toc_strings(spark, sf_dir):
    return entries_of(spark, sf_dir).select("doc_id", "ordinal", toc.entry_string().alias("entry"))


@query("""SELECT l_orderkey AS doc_id, count(*) AS n_entries FROM lineitem GROUP BY 1 HAVING count(*) FILTER (l_returnflag = 'R') = 0""")
def toc_existing_guard(spark, sf_dir):
    docs = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(
        F.count("*").alias("n_entries"),
        F.sort_array(F.collect_list(F.when(F.col("l_returnflag") == "R", F.col("l_linenumber")))).alias("existing_toc"),
    )
    return toc.check_no_existing(docs).select("doc_id", "n_entries")


@query(f"""WITH {ENTRIES_SQL} SELECT -o_orderkey AS doc_id, ordinal, title, page_number, level, confidence FROM entries JOIN orders ON o_orderkey = doc_id WHERE o_orderstatus = 'F'""")
def toc_transplant(spark, sf_dir):
    key = F.col("o_orderkey")
    copies = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(key.alias("copy_id"), (-key).alias("doc_id"))
    return toc.transplant(entries_of(spark, sf_dir), copies)


# ---- Text of document lines and of part names ----

LINES_SQL = r"""lines AS (SELECT doc_id, (unnest(generate_series(1, len(p))) - 1)::INT AS line_no, unnest(p) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents))"""
TITLES = ["{0}. {1}", "Chapter {0} {1}", "{0}.2 {1}", "Appendix A {1}", "IV. {1}", "P R E F A C E {1}", "introduction to {1}", "preface", "introduction to the {0} edition", "part 1 {1}", "i {1}", "{1}"]


def _title_columns() -> list:
    out = []
    for form in TITLES:
        parts = form.replace("{0}", "\x00p_size\x00").replace("{1}", "\x00p_name\x00").split("\x00")
        out.append(F.concat(*[F.col(p).cast("string") if p in ("p_size", "p_name") else F.lit(p) for p in parts if p]))
    return out


TITLES_SQL = "titles AS (SELECT p_partkey, (unnest(generate_series(1, {n})) - 1)::INT AS form, unnest([{all}]) AS title FROM part)".format(
    n=len(TITLES), all=", ".join("concat('" + f.replace("{0}", "', p_size, '").replace("{1}", "', p_name, '") + "')" for f in TITLES)
)


def titles_of(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.posexplode(F.array(*_title_columns())).alias("form", "title"))


@query(f"WITH {LINES_SQL} SELECT doc_id, line_no, {d.normalize_snippet('line')} AS norm, {d.normalize_title('line')} AS title_norm, {d.normalize_for_restore('line')} AS restore_norm FROM lines")
def normalize_lines(spark, sf_dir):
    lines = source.lines_from_documents(table(spark, sf_dir, "documents"))
    line = F.col("line")
    return lines.select("doc_id", "line_no", t.normalize_snippet(line).alias("norm"), t.normalize_title(line).alias("title_norm"), t.normalize_for_restore(line).alias("restore_norm"))


@query(f"""WITH {TITLES_SQL} SELECT p_partkey, form, {d.matches('title', t.SECTION_NUMBER, 'i')} AS section, {d.matches('title', t.LETTERSPACED)} AS spaced,
 {d.matches(d.normalize_front('title'), t.FRONT_MATTER)} AS front, {d.matches(d.normalize_title('title'), t.MAIN_START, 'i')} AS main,
 {d.section_prefix('title')} AS prefix, {d.without_appendix('title')} AS bare FROM titles""")
def classify_titles(spark, sf_dir):
    title = F.col("title")
    return titles_of(spark, sf_dir).select(
        "p_partkey",
        "form",
        t.is_section_number(title).alias("section"),
        t.is_letterspaced(title).alias("spaced"),
        t.is_front_matter(t.normalize_front(title)).alias("front"),
        t.is_main_start(t.normalize_title(title)).alias("main"),
        t.section_prefix(title).alias("prefix"),
        t.without_appendix(title).alias("bare"),
    )


@query(f"""WITH {LINES_SQL}, s AS (SELECT doc_id, line_no, {d.strip('line')} AS l FROM lines)
SELECT doc_id, coalesce(string_agg(l, chr(10) ORDER BY line_no) FILTER ({d.toc_like('l')}), '') AS kept FROM s GROUP BY doc_id""")
def toc_like_lines(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", t.toc_like_lines(F.col("text")).alias("kept"))


@query("""SELECT p_partkey, regexp_replace(CASE WHEN p_size % 2 = 0 THEN 'ABCDEF+' || p_name WHEN p_size % 3 = 0 THEN 'abcdef+' || p_name ELSE p_name END, '^[A-Z]{6}\\+', '') AS font FROM part""".replace("\\\\", "\\"))
def font_names(spark, sf_dir):
    font = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("ABCDEF+"), "p_name")).when(F.col("p_size") % 3 == 0, F.concat(F.lit("abcdef+"), "p_name")).otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", t.strip_subset_prefix(font).alias("font"))


@query(f"""SELECT l_orderkey, l_partkey, l_linenumber, l_extendedprice, {d.format_size('l_extendedprice / 7')} AS shown_size,
{d.round_exact('l_extendedprice / 800.0::DOUBLE / 200.0::DOUBLE', 2)} AS y, {d.format_y(d.round_exact('l_extendedprice / 800.0::DOUBLE / 200.0::DOUBLE', 2))} AS shown_y FROM lineitem""")
def number_formats(spark, sf_dir):
    y = t.round_exact(F.col("l_extendedprice") / 800.0 / 200.0, 2)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice", t.format_size(F.col("l_extendedprice") / 7).alias("shown_size"), y.alias("y"), t.format_y(y).alias("shown_y"))


# ---- Pages as styled spans ----

_SIZE_SQL = "CASE font " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in source.TAG_SIZES.items()) + " END"
SPANS_SQL = f"""raw AS (SELECT page_id AS doc_id, unnest(generate_series(1, len(m))) AS nth, unnest(m) AS m FROM (SELECT page_id, regexp_extract_all(html, {d.quoted(source.TAG_SPAN)}, 0) AS m FROM pages)),
named AS (SELECT doc_id, nth, regexp_extract(m, {d.quoted(source.TAG_SPAN)}, 1) AS font, trim(regexp_extract(m, {d.quoted(source.TAG_SPAN)}, 2)) AS text FROM raw),
spans AS (SELECT doc_id, 1 AS page_number, (count(*) OVER (PARTITION BY doc_id))::DOUBLE AS h, (row_number() OVER (PARTITION BY doc_id ORDER BY nth) - 1)::INT AS b,
  font, {_SIZE_SQL} AS size, text, font IN ('h1', 'b') AS bold FROM named WHERE text <> '')"""
FEATURES_SQL = f"""{SPANS_SQL},
placed AS (SELECT *, {d.round_exact('b / h', 2)} AS y, substr(text, 1, 50) AS snip FROM spans),
early AS (SELECT * FROM placed WHERE b < 3),
counted AS (SELECT doc_id, font, size, count(*) AS n, min(b) AS met FROM early GROUP BY ALL),
body AS (SELECT doc_id, font AS body_font, size AS body_size FROM counted QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, met) = 1),
squeezed AS (SELECT placed.* REPLACE ({d.squeeze(d.strip('text'))} AS text), body_size FROM placed LEFT JOIN body USING (doc_id) WHERE b >= 3),
late AS (SELECT * FROM squeezed WHERE {d.is_heading('substr(text, 1, 50)', 'size', 'bold', 'body_size', '(CASE WHEN y > 0.6::DOUBLE THEN 1.15::DOUBLE ELSE 1.2::DOUBLE END)')}
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY b) <= 3),
features AS (
  SELECT doc_id, page_number, 1 AS phase, b AS block_ix, font AS font_name, size AS font_size, length(text)::INT AS text_length, snip AS text_snippet, y AS y_position, bold AS is_bold FROM early
  UNION ALL SELECT doc_id, page_number, 2, b, font, size, length(text)::INT, substr(text, 1, 50), y, bold FROM late)"""


def spans_of(spark, sf_dir) -> DataFrame:
    return source.spans_from_html(table(spark, sf_dir, "pages"))


def features_of(spark, sf_dir) -> DataFrame:
    return features.extract(spans_of(spark, sf_dir))


@query(f"WITH {SPANS_SQL} SELECT doc_id, b AS block_ix, font, size, text, h AS page_height FROM spans")
def page_spans(spark, sf_dir):
    return spans_of(spark, sf_dir).select("doc_id", "block_ix", "font", "size", "text", "page_height")


@query(f"WITH {FEATURES_SQL} SELECT * FROM features")
def page_features(spark, sf_dir):
    return features_of(spark, sf_dir).drop("line_ix", "span_ix")


@query(f"WITH {FEATURES_SQL} SELECT * FROM body")
def body_font_profile(spark, sf_dir):
    return features.body_font(features.first_blocks(spans_of(spark, sf_dir)))


ALL_COUNTED_SQL = """allcounted AS (SELECT doc_id, font_name, font_size, count(*) AS n, min(phase * 1000000 + block_ix) AS met FROM features GROUP BY ALL),
fbody AS (SELECT doc_id, font_name AS body_font, font_size AS body_size FROM allcounted QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, met) = 1)"""
HEADINGS_SQL = f"""{ALL_COUNTED_SQL},
heads AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY phase, block_ix) AS ordinal, {d.strip('text_snippet')} AS title, page_number,
  (dense_rank() OVER (PARTITION BY doc_id ORDER BY font_size DESC))::INT AS level, 1.0::DOUBLE AS confidence
  FROM features JOIN fbody USING (doc_id) WHERE {d.is_heading('text_snippet', 'font_size', 'is_bold', 'body_size', '1.15::DOUBLE')})"""


@query(f"WITH {FEATURES_SQL}, {HEADINGS_SQL} SELECT * FROM heads")
def heading_candidates(spark, sf_dir):
    return features.heading_entries(features_of(spark, sf_dir))


@query(f"""WITH {FEATURES_SQL}, {HEADINGS_SQL},
k AS (SELECT * FROM heads QUALIFY row_number() OVER (PARTITION BY doc_id, page_number, title ORDER BY ordinal) = 1),
s AS (SELECT * REPLACE (row_number() OVER (PARTITION BY doc_id ORDER BY page_number, level, ordinal) AS ordinal) FROM k)
{SANITIZED.format('s')}""")
def pages_toc(spark, sf_dir):
    return flows.contents_without_inference(spans_of(spark, sf_dir))


FONTS_SQL = """fonts AS (SELECT doc_id, font, row_number() OVER (PARTITION BY doc_id ORDER BY met) - 1 AS font_no FROM (
  SELECT doc_id, regexp_replace(font_name, '^[A-Z]{6}\\+', '') AS font, min(phase * 1000000 + block_ix) AS met FROM features GROUP BY ALL))""".replace("\\\\", "\\")


@query(f"WITH {FEATURES_SQL}, {FONTS_SQL} SELECT doc_id, font, font_no::INT AS font_no FROM fonts")
def font_dictionary(spark, sf_dir):
    return serialize.font_table(features_of(spark, sf_dir))


SERIAL_SQL = f"""{FONTS_SQL},
flines AS (SELECT features.*, concat_ws('|', concat('F', font_no), {d.format_size('font_size')}, text_snippet, {d.format_y('y_position')}, CASE WHEN is_bold THEN 'B' END) AS line
  FROM features JOIN fonts ON fonts.doc_id = features.doc_id AND font = regexp_replace(font_name, '^[A-Z]{{6}}\\+', ''))""".replace("\\\\", "\\")


@query(f"""WITH {FEATURES_SQL}, {SERIAL_SQL},
p AS (SELECT doc_id, page_number, concat('P', page_number, ':', chr(10), string_agg(line, chr(10) ORDER BY phase, block_ix)) AS t FROM flines GROUP BY doc_id, page_number),
b AS (SELECT doc_id, string_agg(t, chr(10) ORDER BY page_number) AS body FROM p GROUP BY 1),
f AS (SELECT doc_id, string_agg(concat('F', font_no::VARCHAR, '=', font), chr(10) ORDER BY font_no) AS head FROM fonts GROUP BY 1)
SELECT doc_id, concat('FONTS:', chr(10), head, chr(10), chr(10), body) AS text FROM b JOIN f USING (doc_id)""")
def serialize_features(spark, sf_dir):
    return serialize.serialize(features_of(spark, sf_dir))


FEATURE_STRING_SQL = """fstrings AS (SELECT *, concat('(', page_number, ', ''', font_name, ''', ', font_size::VARCHAR, ', ', text_length, ', ''', text_snippet, '''', coalesce(', y=' || y_position::VARCHAR, ''),
  CASE WHEN is_bold THEN ', bold=True' WHEN NOT is_bold THEN ', bold=False' ELSE '' END, ')') AS s FROM features)"""


@query(f"WITH {FEATURES_SQL}, {FEATURE_STRING_SQL} SELECT doc_id, phase, block_ix, s FROM fstrings")
def feature_strings(spark, sf_dir):
    return features_of(spark, sf_dir).select("doc_id", "phase", "block_ix", serialize.feature_string().alias("s"))


@query(f"WITH {FEATURES_SQL}, {FEATURE_STRING_SQL} SELECT doc_id, ceil((sum(length(s) + 4) + 2 * count(*)) / 4.0::DOUBLE)::BIGINT AS tokens FROM fstrings GROUP BY 1")
def feature_list_tokens(spark, sf_dir):
    return serialize.feature_list_tokens(features_of(spark, sf_dir))


@query(f"WITH {FEATURES_SQL}, {FEATURE_STRING_SQL} SELECT doc_id, '[' || string_agg('[[' || s || ']]', ', ' ORDER BY phase, block_ix) || ']' AS text FROM fstrings GROUP BY 1")
def feature_list_text(spark, sf_dir):
    return serialize.feature_list_text(features_of(spark, sf_dir))


@query(f"""WITH {FEATURES_SQL} SELECT doc_id, page_number, phase, block_ix, greatest(1, ceil(length(concat('P1:', chr(10), 'F0|12|', text_snippet, '|.12|B')) / 4.0))::BIGINT AS tokens FROM features""")
def block_token_estimates(spark, sf_dir):
    return serialize.block_tokens(features_of(spark, sf_dir))


def _sample_sql(rows: str, keys: str, order: str, n: str) -> str:
    return f"""(SELECT * EXCLUDE (len_, at_) FROM (SELECT *, count(*) OVER (PARTITION BY {keys}) AS len_, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) - 1 AS at_ FROM {rows})
  WHERE len_ <= {n} OR ({n} > 0 AND list_contains(list_transform(generate_series(0, ({n})::BIGINT - 1), lambda i: floor(i * (len_::DOUBLE / ({n})))::BIGINT), at_)))"""


@query(f"""WITH {FEATURES_SQL}, {ALL_COUNTED_SQL},
marked AS (SELECT features.*, CASE WHEN is_bold OR font_size > body_size * 1.1::DOUBLE OR {d.matches(d.strip('text_snippet'), t.SECTION_NUMBER, 'i')} THEN 0 ELSE 1 END AS stratum FROM features JOIN fbody USING (doc_id)),
budgets AS (SELECT *, CASE WHEN stratum = 0 THEN hb ELSE 5 - hb END AS n FROM (SELECT *, least(sum((stratum = 0)::INT) OVER (PARTITION BY doc_id), 4) AS hb FROM marked)),
drawn AS (SELECT * FROM {_sample_sql('budgets', 'doc_id, stratum', 'page_number, phase, block_ix', 'n')})
SELECT doc_id, string_agg(concat_ws(' ', concat('P', page_number, '@', {d.format_y('y_position')}), concat(font_name, ' ', {d.format_size('font_size')}), CASE WHEN is_bold THEN 'B' END, concat('"', text_snippet, '"')),
  chr(10) ORDER BY page_number, y_position, stratum, phase, block_ix) AS text FROM drawn GROUP BY 1""")
def feature_summary(spark, sf_dir):
    return serialize.summary(features_of(spark, sf_dir), 5)


@query(f"""WITH {LINES_SQL}, s AS (SELECT source, lines.doc_id, line_no FROM lines JOIN documents ON documents.doc_id = lines.doc_id)
SELECT * FROM {_sample_sql('s', 'source', 'doc_id, line_no', '37')}""")
def even_sample(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("source", "doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).drop("line")
    return serialize.even_sample(rows, ["source"], ["doc_id", "line_no"], 37)


# One span a block and fewer than ten fonts, so renumbered fonts leave a line's length as it is.
BATCHES_SQL = f"""{FEATURES_SQL}, {SERIAL_SQL},
blk AS (SELECT doc_id, page_number, regexp_replace(font_name, '^[A-Z]{{6}}[+]', '') AS font, line, row_number() OVER (PARTITION BY doc_id ORDER BY page_number, phase, block_ix) - 1 AS at_,
  greatest(1, ceil(length(concat('P1:', chr(10), 'F0|12|', text_snippet, '|.12|B')) / 4.0))::BIGINT AS c FROM flines),
tails AS (SELECT e.doc_id, e.at_, k, b.* EXCLUDE (doc_id, at_, c) FROM blk e, (VALUES (1), (2)) AS ks(k), blk b WHERE b.doc_id = e.doc_id AND b.at_ >= e.at_ - k AND b.at_ < e.at_),
said AS (SELECT doc_id, at_, k, ceil((6 + 1 + sum(DISTINCT_FONTS) + sum(1 + length(line)) + sum(DISTINCT_PAGES)) / 4.0)::BIGINT AS n FROM (
  SELECT *, CASE WHEN row_number() OVER (PARTITION BY doc_id, at_, k, font) = 1 THEN 4 + length(font) ELSE 0 END AS DISTINCT_FONTS,
    CASE WHEN row_number() OVER (PARTITION BY doc_id, at_, k, page_number) = 1 THEN 3 + length(page_number::VARCHAR) ELSE 0 END AS DISTINCT_PAGES FROM tails) GROUP BY ALL),
fold AS (
  SELECT doc_id, at_, 0::BIGINT AS first, c AS used, NULL::BIGINT AS done_first, NULL::BIGINT AS done_end FROM blk WHERE at_ = 0
  UNION ALL
  SELECT b.doc_id, b.at_, CASE WHEN f.used + b.c > 60 AND b.at_ > f.first THEN greatest(f.first, b.at_ - 2) ELSE f.first END,
    b.c + CASE WHEN f.used + b.c > 60 AND b.at_ > f.first THEN m.n ELSE f.used END,
    CASE WHEN f.used + b.c > 60 AND b.at_ > f.first THEN f.first END, CASE WHEN f.used + b.c > 60 AND b.at_ > f.first THEN b.at_ END
  FROM fold f JOIN blk b ON b.doc_id = f.doc_id AND b.at_ = f.at_ + 1 LEFT JOIN said m ON m.doc_id = b.doc_id AND m.at_ = b.at_ AND m.k = least(2, b.at_ - f.first)),
ranges AS (SELECT doc_id, done_first AS first, done_end AS "end" FROM fold WHERE done_end IS NOT NULL
  UNION ALL SELECT doc_id, first, at_ + 1 FROM fold QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY at_ DESC) = 1)"""


@query(f"""WITH RECURSIVE {BATCHES_SQL} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY "end") AS batch_ix, first, "end" FROM ranges""")
def feature_batches(spark, sf_dir):
    return batching.feature_batches(serialize.feature_lines(features_of(spark, sf_dir)), batching.FEATURE_OVERHEAD + 60, 2)


# ---- Printed contents and offsets: one document a brand ----

PRINTED_SQL = """parts AS (SELECT *, regexp_extract(p_brand, '(\\d+)$', 1)::BIGINT AS brand_no FROM part),
plines AS (SELECT brand_no AS doc_id, p_partkey AS line_no, concat(p_name, ' ', lpad(p_partkey::VARCHAR, 6, '0'), ' ........ ', p_size) AS line FROM parts),
pentries AS (SELECT brand_no AS doc_id, p_partkey AS ordinal, concat(p_name, ' ', lpad(p_partkey::VARCHAR, 6, '0')) AS title,
  (p_size + CASE WHEN p_partkey % 7 = 0 THEN 1 ELSE brand_no % 9 END)::BIGINT AS page_number, 1 AS level, 1.0::DOUBLE AS confidence FROM parts)""".replace("\\\\", "\\")
PARSED_SQL = f"""parsed AS (SELECT *, {d.normalize_snippet('title')} AS norm FROM (
  SELECT doc_id, line_no, {d.sub(d.sub('s', r'[0-9]+\s*$', flags=''), '^[ .·…' + chr(9) + ']+|[ .·…' + chr(9) + ']+$')} AS title, regexp_extract(s, '([0-9]+)\\s*$', 1)::BIGINT AS printed_page
  FROM (SELECT *, {d.strip('line')} AS s FROM plines) WHERE s <> '' AND length(s) <= 200 AND {d.matches('s', t.TRAILING_NUMBER)}) WHERE length({d.normalize_snippet('title')}) >= 8)""".replace("\\\\", "\\")


def printed_of(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    part = table(spark, sf_dir, "part").withColumn("brand_no", F.regexp_extract("p_brand", r"(\d+)$", 1).cast("long"))
    title = F.concat(F.col("p_name"), F.lit(" "), F.lpad(F.col("p_partkey").cast("string"), 6, "0"))
    lines = part.select(F.col("brand_no").alias("doc_id"), F.col("p_partkey").alias("line_no"), F.concat(title, F.lit(" ........ "), F.col("p_size").cast("string")).alias("line"))
    page = F.col("p_size") + F.when(F.col("p_partkey") % 7 == 0, 1).otherwise(F.col("brand_no") % 9)
    entries = part.select(F.col("brand_no").alias("doc_id"), F.col("p_partkey").alias("ordinal"), title.alias("title"), page.cast("long").alias("page_number"), F.lit(1).alias("level"), F.lit(1.0).alias("confidence"))
    return lines, entries


@query(f"WITH {PRINTED_SQL}, {PARSED_SQL} SELECT * FROM parsed")
def printed_entries(spark, sf_dir):
    return offsets.printed_entries(printed_of(spark, sf_dir)[0])


# Every title ends in its part key, so titles match only where the normal forms are equal or one holds the other; equal forms decide here.
OFFSET_SQL = f"""{PRINTED_SQL}, {PARSED_SQL},
normal AS (SELECT *, {d.normalize_snippet('title')} AS e_norm FROM pentries),
taken AS (SELECT p.doc_id, p.line_no, p.printed_page, arg_min(n.page_number, n.ordinal) AS page_number FROM parsed p JOIN normal n ON n.doc_id = p.doc_id AND {d.titles_match('p.norm', 'n.e_norm')} GROUP BY ALL),
offs AS (SELECT doc_id, line_no, page_number - printed_page AS off FROM taken WHERE page_number - printed_page >= 3),
oc AS (SELECT doc_id, off, count(*) AS n, min(line_no) AS met FROM offs GROUP BY ALL),
ref AS (SELECT doc_id, off AS reference_offset FROM (SELECT *, sum(n) OVER (PARTITION BY doc_id) AS al FROM oc) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, met) = 1 AND n >= 3 AND n / al::DOUBLE >= 0.6)"""


@query(f"WITH {OFFSET_SQL} SELECT * FROM ref")
def reference_offset(spark, sf_dir):
    lines, entries = printed_of(spark, sf_dir)
    return offsets.reference_offset(offsets.printed_entries(lines), entries)


ANCHOR_ENTRIES_SQL = f"{TITLES_SQL}, aentries AS (SELECT p_partkey % 97 AS doc_id, p_partkey * 100 + form AS ordinal, title, ((p_partkey * 31 + form * 17) % 60)::BIGINT AS page_number, 1 + form % 2 AS level FROM titles)"


def anchored_entries(spark, sf_dir) -> DataFrame:
    return titles_of(spark, sf_dir).select(
        (F.col("p_partkey") % 97).alias("doc_id"),
        (F.col("p_partkey") * 100 + F.col("form")).alias("ordinal"),
        "title",
        ((F.col("p_partkey") * 31 + F.col("form") * 17) % 60).alias("page_number"),
        (1 + F.col("form") % 2).alias("level"),
    )


ANCHOR_SQL = f"""{ANCHOR_ENTRIES_SQL},
roots AS (SELECT *, {d.matches(d.normalize_front('title'), t.FRONT_MATTER)} AS front, {d.matches(d.normalize_title('title'), t.MAIN_START, 'i')} AS main FROM aentries WHERE level = 1 AND page_number > 5),
behind AS (SELECT * FROM (SELECT *, max(page_number) FILTER (front) OVER (PARTITION BY doc_id) AS last FROM roots) WHERE last IS NULL OR page_number > last),
anchored AS (SELECT doc_id, coalesce(arg_min(page_number, ordinal) FILTER (main) - 1, arg_min(page_number, ordinal) FILTER (NOT front) - 1, 0) AS a FROM behind GROUP BY 1)"""


@query(f"WITH {ANCHOR_SQL} SELECT doc_id, coalesce(a, 0)::BIGINT AS \"offset\" FROM (SELECT DISTINCT doc_id FROM aentries) LEFT JOIN anchored USING (doc_id)")
def front_matter_offset(spark, sf_dir):
    return offsets.front_matter_offset(anchored_entries(spark, sf_dir))


@query("""SELECT p_partkey, CASE WHEN p_size >= 3 THEN concat('This document has about ', p_size, ' pages before its main text. Printed page 1 is PDF page ', p_size + 1,
 ': keep the page numbers of existing entries, and for printed ones use PDF page N + ', p_size, ' (by adding ', p_size, ').') ELSE '' END AS note FROM part""")
def offset_notes(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", offsets.offset_note(F.col("p_size")).alias("note"))


# ---- Documents as pages of ten lines, one long document for each source ----

DOC_PAGES_SQL = f"""{LINES_SQL},
numbered AS (SELECT row_number() OVER (PARTITION BY source ORDER BY lines.doc_id, line_no) - 1 AS n, replace(source, 'src', '')::BIGINT AS doc_id, line FROM lines JOIN documents ON documents.doc_id = lines.doc_id),
placed AS (SELECT doc_id, n AS ordinal, (n // 10 + 1) AS page_number, (n % 10) / 10.0::DOUBLE AS y, line FROM numbered)"""


def document_lines(spark, sf_dir) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select("source", "doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    n = F.row_number().over(Window.partitionBy("source").orderBy("doc_id", "line_no")) - 1
    return lines.withColumn("n", n.cast("long")).select(
        F.replace("source", F.lit("src"), F.lit("")).cast("long").alias("doc_id"),
        F.col("n").alias("ordinal"),
        (F.floor(F.col("n") / 10) + 1).alias("page_number"),
        (F.col("n") % 10 / 10.0).alias("y"),
        "line",
    )


ZONES_SQL = f"""{DOC_PAGES_SQL},
normed AS (SELECT *, {d.normalize_snippet('line')} AS norm FROM placed),
zones AS (SELECT doc_id, page_number, coalesce(string_agg(' ' || norm, '' ORDER BY ordinal) FILTER (y < 0.05), '') AS header, coalesce(string_agg(' ' || norm, '' ORDER BY ordinal) FILTER (y >= 0.05), '') AS body
  FROM normed WHERE norm <> '' GROUP BY ALL)"""


@query(f"WITH {ZONES_SQL} SELECT * FROM zones")
def zone_texts(spark, sf_dir):
    lines = document_lines(spark, sf_dir)
    return correction.zone_text(lines.select("doc_id", "page_number", "ordinal", F.col("y").alias("y_position"), F.col("line").alias("text_snippet")))


def _either_sql(title: str, zone: str) -> str:
    return f"(coalesce({zone}, '') <> '' AND (contains({zone}, {title}) OR contains({title}, {d.strip(zone)})))"


HEADER_FIX_SQL = f"""{ZONES_SQL},
e AS (SELECT doc_id, ordinal, line AS title, page_number, norm FROM normed WHERE y < 0.05),
judged AS (SELECT e.*, length(norm) >= 3 AND e.page_number > 1 AND coalesce(h.header, '') <> '' AND {_either_sql('norm', 'h.header')} AND NOT {_either_sql('norm', 'h.body')} AS only_header, {_either_sql('norm', 'p.body')} AS found
  FROM e LEFT JOIN zones h ON h.doc_id = e.doc_id AND h.page_number = e.page_number LEFT JOIN zones p ON p.doc_id = e.doc_id AND p.page_number = e.page_number - 1)"""


@query(f"WITH {HEADER_FIX_SQL} SELECT doc_id, ordinal, title, CASE WHEN only_header AND found THEN page_number - 1 ELSE page_number END AS page_number FROM judged")
def running_header_fix(spark, sf_dir):
    lines = document_lines(spark, sf_dir)
    feats = lines.select("doc_id", "page_number", "ordinal", F.col("y").alias("y_position"), F.col("line").alias("text_snippet"))
    entries = lines.where("y < 0.05").select("doc_id", "ordinal", F.col("line").alias("title"), "page_number")
    return correction.correct_running_headers(entries, feats)


@query(f"WITH {HEADER_FIX_SQL} SELECT doc_id, count(*) AS entries, count(*) FILTER (only_header AND found) AS corrected FROM judged GROUP BY 1")
def correction_counts(spark, sf_dir):
    entries = document_lines(spark, sf_dir).where("y < 0.05").select("doc_id", "ordinal", F.col("line").alias("title"), "page_number")
    return correction.correction_counts(entries, running_header_fix(spark, sf_dir))


BLOCK_FORMS_SQL = f"""{DOC_PAGES_SQL},
cand AS (SELECT *, {d.normalize_snippet('line')} AS cand_norm, {d.normalize_title('line')} AS cand_title FROM placed),
titled AS (SELECT doc_id, ordinal, line AS title, page_number, {d.normalize_snippet('line')} AS norm, {d.normalize_snippet(d.without_appendix('line'))} AS norm_without FROM placed WHERE ordinal % 10 = 0)"""


def _entries_and_blocks(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    lines = document_lines(spark, sf_dir)
    entries = lines.where("ordinal % 10 = 0").select("doc_id", "ordinal", F.col("line").alias("title"), "page_number")
    return entries, lines.select("doc_id", "page_number", F.col("ordinal").alias("block_ix"), "y", F.col("line").alias("text"))


@query(f"""WITH {BLOCK_FORMS_SQL} SELECT DISTINCT e.doc_id, e.ordinal, e.title, e.page_number - 1 AS page_number FROM titled e JOIN cand c ON c.doc_id = e.doc_id AND c.page_number = e.page_number - 1 AND c.y > 0.5
WHERE length(norm) >= 3 AND {d.heading_matches('e.title', 'norm', 'norm_without', 'cand_norm', 'cand_title')}""")
def heading_in_lower_half(spark, sf_dir):
    entries, blocks = _entries_and_blocks(spark, sf_dir)
    return correction.heading_in_lower_half(entries.withColumn("page_number", F.col("page_number") - 1), blocks)


@query(f"""WITH {BLOCK_FORMS_SQL},
texts AS (SELECT doc_id, page_number, string_agg(line, chr(10) ORDER BY ordinal) AS text FROM placed GROUP BY ALL),
tc AS (SELECT *, {d.normalize_snippet('text')} AS cand_norm, {d.normalize_title('text')} AS cand_title FROM texts)
SELECT DISTINCT e.doc_id, e.ordinal, e.title, e.page_number FROM titled e JOIN tc c ON c.doc_id = e.doc_id AND c.page_number BETWEEN e.page_number - 1 AND e.page_number + 1
WHERE length(norm) >= 3 AND {d.heading_matches('e.title', 'norm', 'norm_without', 'cand_norm', 'cand_title')}""")
def page_contains_heading(spark, sf_dir):
    entries, _ = _entries_and_blocks(spark, sf_dir)
    lines = document_lines(spark, sf_dir)
    pages = lines.groupBy("doc_id", "page_number").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "line"))), lambda x: x["line"]), "\n").alias("text"))
    return correction.page_contains_heading(entries, pages)


NEAREST_SQL = f"""{BLOCK_FORMS_SQL},
w AS (SELECT *, greatest(1, page_number - 4) AS s, page_number + 5 AS e_, page_number AS hint FROM titled WHERE length(norm) >= 3),
hits AS (SELECT w.doc_id, w.ordinal, c.page_number AS p, abs(c.page_number - hint) AS reach, c.page_number < hint AS before FROM w JOIN cand c ON c.doc_id = w.doc_id AND c.page_number >= s AND c.page_number < e_
  AND c.y BETWEEN 0.06 AND 0.95 AND {d.heading_matches('w.title', 'w.norm', 'w.norm_without', 'c.cand_norm', 'c.cand_title')})"""


@query(f"WITH {NEAREST_SQL} SELECT doc_id, ordinal, p AS found_page FROM hits QUALIFY row_number() OVER (PARTITION BY doc_id, ordinal ORDER BY reach, before) = 1")
def nearest_heading(spark, sf_dir):
    entries, blocks = _entries_and_blocks(spark, sf_dir)
    wanted = entries.select("doc_id", "ordinal", "title", F.greatest(F.lit(1), F.col("page_number") - 4).alias("start_page"), (F.col("page_number") + 5).alias("end_page"), F.col("page_number").alias("hint_page"))
    return correction.nearest_heading(wanted, blocks)


@query(f"""WITH {BLOCK_FORMS_SQL},
counts AS (SELECT doc_id, max(page_number) AS page_count FROM placed GROUP BY 1),
w AS (SELECT t.doc_id, ordinal, title, norm, norm_without, page_number + 2 AS hint, greatest(1, page_number + 2 - 4) AS s, least(page_count, page_number + 2 + 4) AS e_ FROM titled t JOIN counts c ON c.doc_id = t.doc_id),
hits AS (SELECT w.doc_id, w.ordinal, c.page_number AS p, abs(c.page_number - hint) AS reach, c.page_number < hint AS before FROM w JOIN cand c ON c.doc_id = w.doc_id AND c.page_number BETWEEN s AND e_
  AND length(w.norm) >= 8 AND c.y BETWEEN 0.06 AND 0.95 AND {d.heading_matches('w.title', 'w.norm', 'w.norm_without', 'c.cand_norm', 'c.cand_title')}),
best AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY doc_id, ordinal ORDER BY reach, before) = 1)
SELECT w.doc_id, w.ordinal, title, coalesce(p, hint) AS page_number FROM w LEFT JOIN best ON best.doc_id = w.doc_id AND best.ordinal = w.ordinal""")
def verified_pages(spark, sf_dir):
    entries, blocks = _entries_and_blocks(spark, sf_dir)
    counts = blocks.groupBy("doc_id").agg(F.max("page_number").alias("page_count"))
    shifts = counts.select("doc_id", F.lit(4).alias("offset"))
    return correction.verify_pages(entries.withColumn("page_number", F.col("page_number") + 2), shifts, blocks, counts)


# ---- Books: the lines of a source as pages of six blocks of seven lines of up to three spans; some blocks are images ----

BOOK_FONTS = ("ABCDEF+Serif", "Sans-Bold", "Mono")
BOOK_SQL = f"""{LINES_SQL},
numbered AS (SELECT row_number() OVER (PARTITION BY source ORDER BY lines.doc_id, line_no) - 1 AS n, replace(source, 'src', '')::BIGINT AS doc_id, line FROM lines JOIN documents ON documents.doc_id = lines.doc_id),
pieces AS (SELECT *, unnest([0, 1, 2]) AS k, unnest([substr(line, 1, 20), substr(line, 21, 20), substr(line, 41)]) AS text FROM numbered),
spans AS (SELECT doc_id, n // 42 + 1 AS page_number, ((n // 7) % 6)::INT AS block_ix, (n % 7)::INT AS line_ix, k::INT AS span_ix, ((n // 7) % 11 = 3) AS image, text,
  ['ABCDEF+Serif', 'Sans-Bold', 'Mono'][(n + k) % 3 + 1] AS font, (8 + (n // 7) % 5 * 2)::DOUBLE AS size, (n % 42 + 1) AS y0, n % 13 = 0 OR (n + k) % 3 = 1 AS bold FROM pieces WHERE k = 0 OR text <> '')"""
BOOK_FEATURES_SQL = f"""{BOOK_SQL},
early AS (SELECT *, {d.round_exact('y0 / 45.0::DOUBLE', 2)} AS y FROM spans WHERE block_ix < 3 AND line_ix < 5 AND NOT image),
counted AS (SELECT doc_id, font, size, count(*) AS n, min((page_number, block_ix, line_ix, span_ix)) AS met FROM early GROUP BY ALL),
body AS (SELECT doc_id, size AS body_size FROM counted QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, met) = 1),
joined AS (SELECT doc_id, page_number, block_ix, any_value(size) AS size, any_value(y0) AS y0, arg_min(font, span_ix) AS font, arg_min(bold, span_ix) AS first_bold, bool_or(bold) AS bold,
  {d.squeeze(d.strip("string_agg(" + d.strip('text') + ", ' ' ORDER BY span_ix)"))} AS text FROM spans WHERE block_ix >= 3 AND line_ix = 0 AND NOT image GROUP BY ALL),
late AS (SELECT * FROM (SELECT joined.*, body_size, {d.round_exact('y0 / 45.0::DOUBLE', 2)} AS y FROM joined LEFT JOIN body USING (doc_id))
  WHERE {d.is_heading('substr(text, 1, 50)', 'size', 'first_bold', 'body_size', '(CASE WHEN y > 0.6::DOUBLE THEN 1.15::DOUBLE ELSE 1.2::DOUBLE END)')}
  QUALIFY row_number() OVER (PARTITION BY doc_id, page_number ORDER BY block_ix) <= 3),
features AS (
  SELECT doc_id, page_number, 1 AS phase, block_ix, line_ix, span_ix, font AS font_name, size AS font_size, length(text)::INT AS text_length, substr(text, 1, 50) AS text_snippet, y AS y_position, bold AS is_bold FROM early
  UNION ALL SELECT doc_id, page_number, 2, block_ix, 0, 0, font, size, length(text)::INT, substr(text, 1, 50), y, bold FROM late)"""


def book_spans(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lines = source.lines_from_documents(docs.select("doc_id", "text")).join(docs.select("doc_id", "source"), "doc_id")
    at = Window.partitionBy("source").orderBy("doc_id", "line_no")
    numbered = lines.select(F.regexp_replace("source", "src", "").cast("long").alias("doc_id"), (F.row_number().over(at) - 1).alias("n"), "line")
    parts = F.array(F.substring("line", 1, 20), F.substring("line", 21, 20), F.expr("substring(line, 41)"))
    n, k = F.col("n"), F.col("k")
    # A page is a row of nested blocks, as parsers give them, and goes through the source's own reading.
    spans = numbered.select("doc_id", "n", F.posexplode(parts).alias("k", "text")).where((k == 0) | (F.col("text") != "")).select(
        "doc_id",
        "n",
        "k",
        F.struct(
            F.element_at(F.array(*map(F.lit, BOOK_FONTS)), ((n + k) % 3 + 1).cast("int")).alias("font"),
            (8 + F.floor(n / 7) % 5 * 2).cast("double").alias("size"),
            "text",
            F.struct(F.lit(0.0).alias("x0"), (n % 42 + 1).cast("double").alias("y0"), F.lit(0.0).alias("x1"), F.lit(0.0).alias("y1")).alias("bbox"),
            F.when(n % 13 == 0, 16).otherwise(0).alias("flags"),
        ).alias("span"),
    )
    ordered = lambda key, value: F.transform(F.sort_array(F.collect_list(F.struct(key, value))), lambda x: x[value])
    rows = spans.groupBy("doc_id", "n").agg(ordered("k", "span").alias("spans")).select("doc_id", "n", F.floor(n / 7).alias("b"), F.struct("spans").alias("line"))
    blocks = rows.groupBy("doc_id", "b").agg(ordered("n", "line").alias("lines")).select("doc_id", "b", F.struct((F.col("b") % 11 == 3).cast("int").alias("type"), "lines").alias("block"))
    pages = blocks.groupBy("doc_id", (F.floor(F.col("b") / 6) + 1).alias("page_number")).agg(F.lit(45.0).alias("height"), ordered("b", "block").alias("blocks"))
    return source.spans_from_pages(pages)


@query(f"WITH {BOOK_FEATURES_SQL} SELECT * FROM features")
def book_features(spark, sf_dir):
    return features.extract(book_spans(spark, sf_dir))


@query(f"""WITH {BOOK_FEATURES_SQL},
met AS (SELECT doc_id, regexp_replace(font_name, '^[A-Z]{{6}}[+]', '') AS font, min((page_number, phase, block_ix, line_ix, span_ix)) AS met FROM features GROUP BY ALL),
fonts AS (SELECT doc_id, font, row_number() OVER (PARTITION BY doc_id ORDER BY met) - 1 AS font_no FROM met),
flines AS (SELECT features.*, concat_ws('|', concat('F', font_no), {d.format_size('font_size')}, text_snippet, {d.format_y('y_position')}, CASE WHEN is_bold THEN 'B' END) AS line
  FROM features JOIN fonts ON fonts.doc_id = features.doc_id AND font = regexp_replace(font_name, '^[A-Z]{{6}}[+]', '')),
p AS (SELECT doc_id, page_number, concat('P', page_number, ':', chr(10), string_agg(line, chr(10) ORDER BY phase, block_ix, line_ix, span_ix)) AS t FROM flines GROUP BY doc_id, page_number),
b AS (SELECT doc_id, string_agg(t, chr(10) ORDER BY page_number) AS body FROM p GROUP BY 1),
f AS (SELECT doc_id, string_agg(concat('F', font_no::VARCHAR, '=', font), chr(10) ORDER BY font_no) AS head FROM fonts GROUP BY 1)
SELECT doc_id, concat('FONTS:', chr(10), head, chr(10), chr(10), body) AS text FROM b JOIN f USING (doc_id)""")
def book_serialized(spark, sf_dir):
    return serialize.serialize(features.extract(book_spans(spark, sf_dir)))


@query(f"""WITH {BOOK_SQL}, l AS (SELECT doc_id, page_number, block_ix, line_ix, string_agg(text, '' ORDER BY span_ix) AS t FROM spans GROUP BY ALL)
SELECT doc_id, page_number, string_agg(t, chr(10) ORDER BY block_ix, line_ix) AS text FROM l GROUP BY ALL""")
def book_text(spark, sf_dir):
    return source.plain_text(book_spans(spark, sf_dir))


# ---- Restored pages: titles of web pages against their first bold text ----

RESTORE_SQL = f"""orig AS (SELECT page_id % 20 AS doc_id, page_id AS ordinal, trim(regexp_extract(html, '<h1>([^<]*)', 1)) AS title, page_id AS page_number, 1 AS level FROM pages),
refd AS (SELECT page_id % 20 AS doc_id, page_id AS ordinal, trim(CASE WHEN page_id % 3 = 0 THEN regexp_extract(html, '<title>([^<]*)', 1) ELSE regexp_extract(html, '<p><b>([^<]*)', 1) END) AS title, 0::BIGINT AS page_number, 1 AS level FROM pages),
keyed AS (SELECT *, {d.normalize_for_restore('title')} AS key FROM orig),
firsts AS (SELECT k.doc_id, k.level, k.key, arg_min(page_number, ordinal) AS orig_page, min(ordinal) AS first, min(ordinal) AS met FROM keyed k GROUP BY ALL),
want AS (SELECT *, {d.normalize_for_restore('title')} AS r_key FROM refd),
ex AS (SELECT w.*, f.orig_page AS exact_page FROM want w LEFT JOIN firsts f ON f.doc_id = w.doc_id AND f.level = w.level AND f.key = w.r_key),
fz AS (SELECT o.doc_id, o.level, o.r_key, f.orig_page FROM (SELECT DISTINCT doc_id, level, r_key FROM ex WHERE exact_page IS NULL) o JOIN firsts f ON f.doc_id = o.doc_id AND f.level = o.level AND {d.contains_ratio('f.key', 'o.r_key')}
  QUALIFY row_number() OVER (PARTITION BY o.doc_id, o.level, o.r_key ORDER BY {d.ratio('f.key', 'o.r_key')} DESC, met, first) = 1)"""


@query(f"WITH {RESTORE_SQL} SELECT ex.doc_id, ordinal, title, coalesce(exact_page, fz.orig_page, page_number)::BIGINT AS page_number, ex.level FROM ex LEFT JOIN fz ON fz.doc_id = ex.doc_id AND fz.level = ex.level AND fz.r_key = ex.r_key")
def restore_pages(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    doc = (F.col("page_id") % 20).alias("doc_id")
    orig = pages.select(doc, F.col("page_id").alias("ordinal"), F.trim(F.regexp_extract("html", "<h1>([^<]*)", 1)).alias("title"), F.col("page_id").alias("page_number"), F.lit(1).alias("level"))
    title = F.when(F.col("page_id") % 3 == 0, F.regexp_extract("html", "<title>([^<]*)", 1)).otherwise(F.regexp_extract("html", "<p><b>([^<]*)", 1))
    refined = pages.select(doc, F.col("page_id").alias("ordinal"), F.trim(title).alias("title"), F.lit(0).cast("long").alias("page_number"), F.lit(1).alias("level"))
    return correction.restore_pages(refined, orig)


# ---- Recognition, ranges, reference text ----


@query("""WITH p AS (SELECT conv_id AS doc_id, turn + 1 AS page_number, length(text) > 900 AS has_text FROM conversations),
c AS (SELECT doc_id, count(*) AS pages, count(*) FILTER (has_text) AS with_text FROM p WHERE page_number <= 3 GROUP BY 1)
SELECT k.doc_id, coalesce(pages, 0) AS pages, coalesce(with_text, 0) AS with_text, coalesce(pages, 0) = 0 OR coalesce(with_text, 0) = 0 OR with_text / pages::DOUBLE < 0.25 AS needs_ocr
FROM (SELECT DISTINCT conv_id AS doc_id FROM conversations UNION SELECT -1) k LEFT JOIN c USING (doc_id)""")
def ocr_coverage(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    pages = turns.select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).alias("page_number"), (F.length("text") > 900).alias("has_text"))
    docs = pages.select("doc_id").unionByName(spark.range(1).select(F.lit(-1).cast("long").alias("doc_id")))
    return ocr.needs_ocr(docs, pages, sample_pages=3)


@query("""WITH parts AS (SELECT conv_id % 10 AS doc_id, conv_id AS part, turn + 1 AS page_number, text FROM conversations),
sizes AS (SELECT doc_id, part, max(page_number) AS n FROM parts GROUP BY ALL),
starts AS (SELECT doc_id, part, coalesce(sum(n) OVER (PARTITION BY doc_id ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM sizes)
SELECT doc_id, part, (page_number + b)::BIGINT AS page_number, text FROM parts JOIN starts USING (doc_id, part)""")
def concat_pages(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    return source.concatenated(turns.select((F.col("conv_id") % 10).alias("doc_id"), F.col("conv_id").alias("part"), (F.col("turn") + 1).alias("page_number"), "text"))


@query("""WITH p AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS page_ix, count(*) OVER (PARTITION BY source) AS page_count FROM documents)
SELECT source, doc_id, page_ix::INT AS page_ix, page_count, least(page_ix // greatest(1, page_count // 4), 3)::INT AS part FROM p""")
def page_ranges(spark, sf_dir):
    w = Window.partitionBy("source")
    pages = table(spark, sf_dir, "documents").select("source", "doc_id", (F.row_number().over(w.orderBy("doc_id")) - 1).alias("page_ix"), F.count("*").over(w).alias("page_count"))
    return features.page_ranges(pages, 4)


@query(f"""WITH {DOC_PAGES_SQL},
texts AS (SELECT doc_id, page_number, string_agg(line, chr(10) ORDER BY ordinal) AS text FROM placed WHERE page_number <= 20 GROUP BY ALL),
kept AS (SELECT doc_id, page_number, CASE WHEN page_number <= 3 THEN text ELSE array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda l: {d.strip('l')}), lambda l: {d.toc_like('l')}), chr(10)) END AS t FROM texts WHERE {d.strip('text')} <> '')
SELECT doc_id, string_agg(concat('--- Page ', page_number, ' ---', chr(10), t), chr(10) || chr(10) ORDER BY page_number) AS text FROM kept WHERE {d.strip('t')} <> '' GROUP BY 1""")
def reference_text(spark, sf_dir):
    lines = document_lines(spark, sf_dir).where("page_number <= 20")
    pages = lines.groupBy("doc_id", "page_number").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "line"))), lambda x: x["line"]), "\n").alias("text"))
    return offsets.reference_text(pages)


# ---- Batches and usage over conversations ----

GREEDY_SQL = """turns AS (SELECT conv_id, turn, ceil(length(concat('- ', text, chr(10))) / 4.0)::BIGINT AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
walk(conv_id, turn, i, used, batch_ix) AS (
  SELECT conv_id, turn, i, c, 1::BIGINT FROM turns WHERE i = 1
  UNION ALL SELECT n.conv_id, n.turn, n.i, CASE WHEN w.used + n.c > 200 AND w.used > 0 THEN n.c ELSE w.used + n.c END, CASE WHEN w.used + n.c > 200 AND w.used > 0 THEN w.batch_ix + 1 ELSE w.batch_ix END
  FROM walk w JOIN turns n ON n.conv_id = w.conv_id AND n.i = w.i + 1)"""


def _names(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), F.col("text").alias("name"))


@query(f"WITH RECURSIVE {GREEDY_SQL} SELECT conv_id, turn::BIGINT AS turn, batch_ix FROM walk")
def batch_turns(spark, sf_dir):
    return batching.name_batches(_names(spark, sf_dir), "conv_id", "turn", batching.NAME_OVERHEAD + 200).select("conv_id", "turn", "batch_ix")


@query(f"""WITH RECURSIVE {GREEDY_SQL}, s AS (SELECT conv_id, batch_ix, count(*) AS size FROM walk GROUP BY ALL)
SELECT *, coalesce(sum(size) OVER (PARTITION BY conv_id ORDER BY batch_ix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS files_before FROM s""")
def batch_running(spark, sf_dir):
    batched = batching.name_batches(_names(spark, sf_dir), "conv_id", "turn", batching.NAME_OVERHEAD + 200)
    return batching.files_before(batched, "conv_id")


CALLS_SQL = """calls AS (SELECT conv_id, turn AS ordinal, CASE WHEN role = 'assistant' THEN 0 ELSE ceil(length(text) / 4.0)::BIGINT END AS input_tokens, CASE WHEN role = 'assistant' THEN ceil(length(text) / 4.0)::BIGINT ELSE 0 END AS output_tokens FROM conversations),
totals AS (SELECT conv_id, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens, count(*) AS llm_calls, sum(input_tokens + output_tokens)::BIGINT AS total_tokens FROM calls GROUP BY 1)"""


def _calls(spark, sf_dir) -> DataFrame:
    n, back = t.proxy_tokens(F.col("text")), F.col("role") == "assistant"
    return table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("ordinal"), F.when(back, 0).otherwise(n).alias("input_tokens"), F.when(back, n).otherwise(0).alias("output_tokens"))


@query(f"WITH {CALLS_SQL} SELECT * FROM totals")
def token_usage(spark, sf_dir):
    return usage.total(_calls(spark, sf_dir), ["conv_id"])


@query(f"WITH {CALLS_SQL} SELECT conv_id, ordinal, input_tokens, output_tokens, row_number() OVER (PARTITION BY conv_id ORDER BY ordinal) AS call_number FROM calls")
def usage_calls(spark, sf_dir):
    return usage.numbered(_calls(spark, sf_dir), ["conv_id"])


def _sep(c: str) -> str:
    return f"format('{{:,}}', {c})"


@query(f"WITH {CALLS_SQL} SELECT conv_id, concat('calls: ', {_sep('llm_calls')}, ', input: ', {_sep('input_tokens')}, ', output: ', {_sep('output_tokens')}, ', total: ', {_sep('total_tokens')}) AS line FROM totals")
def usage_report(spark, sf_dir):
    return usage.report(usage.total(_calls(spark, sf_dir), ["conv_id"]), ["conv_id"])


# ---- Renames: page addresses as paths ----

PATHS_SQL = r"named AS (SELECT page_id, concat(url, '/', page_id // 2) AS path, regexp_extract(concat(url, '/', page_id // 2), '[^/]*$') AS filename FROM pages)"


def _paths(spark, sf_dir) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", F.concat("url", F.lit("/"), F.expr("page_id div 2").cast("string")).alias("path"))


@query(f"WITH {PATHS_SQL} SELECT page_id, path, filename FROM named")
def rename_paths(spark, sf_dir):
    return rename.paths_with_names(_paths(spark, sf_dir))


@query(f"WITH {PATHS_SQL} SELECT filename, count(*) AS n FROM named GROUP BY 1 HAVING count(*) > 1")
def rename_duplicates(spark, sf_dir):
    return rename.duplicate_names(_paths(spark, sf_dir))


OPS_SQL = """ops AS (SELECT page_id AS ordinal, (page_id // 2)::VARCHAR AS input_filename, CASE WHEN page_id % 5 = 0 THEN (page_id // 2)::VARCHAR ELSE concat(page_id, '.html') END AS output_filename,
  (page_id % 11) / 10.0::DOUBLE AS confidence, repeat('because ', (page_id % 12)::INT) AS reasoning, page_id % 3 AS batch_ix FROM pages)"""


def _ops(spark, sf_dir) -> DataFrame:
    half = F.expr("page_id div 2").cast("string")
    return table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("ordinal"),
        half.alias("input_filename"),
        F.when(F.col("page_id") % 5 == 0, half).otherwise(F.concat(F.col("page_id").cast("string"), F.lit(".html"))).alias("output_filename"),
        (F.col("page_id") % 11 / 10.0).alias("confidence"),
        F.expr("repeat('because ', cast(page_id % 12 as int))").alias("reasoning"),
        (F.col("page_id") % 3).alias("batch_ix"),
    )


RESOLVE_SQL = f"""{PATHS_SQL}, {OPS_SQL},
resolved AS (SELECT * FROM (SELECT ordinal, path AS source, concat(regexp_replace(path, '[^/]*$', ''), output_filename) AS target FROM ops JOIN named ON filename = input_filename) WHERE source <> target)"""


@query(f"WITH {RESOLVE_SQL} SELECT * FROM resolved")
def rename_resolve(spark, sf_dir):
    return rename.resolve(_ops(spark, sf_dir), rename.paths_with_names(_paths(spark, sf_dir)))


@query(f"WITH {OPS_SQL} SELECT * FROM ops QUALIFY row_number() OVER (PARTITION BY input_filename ORDER BY batch_ix, ordinal) = 1")
def rename_merge(spark, sf_dir):
    return rename.merge(_ops(spark, sf_dir))


@query(f"WITH {OPS_SQL} SELECT ordinal, concat('RenameOp(''', input_filename, ''' -> ''', output_filename, ''', confidence=', confidence::VARCHAR, ')') AS op FROM ops")
def rename_strings(spark, sf_dir):
    return _ops(spark, sf_dir).select("ordinal", rename.operation_string().alias("op"))


@query(f"""WITH {OPS_SQL}, c AS (SELECT *, round({d.round_exact('confidence', 2)} * 100)::BIGINT AS n FROM ops)
SELECT ordinal, input_filename, output_filename, concat(n // 100, '.', lpad((n % 100)::VARCHAR, 2, '0')) AS confidence, CASE WHEN ops.confidence >= 0.9 THEN 'green' WHEN ops.confidence >= 0.7 THEN 'yellow' ELSE 'red' END AS colour,
CASE WHEN length(reasoning) > 50 THEN substr(reasoning, 1, 50) || '...' ELSE reasoning END AS reasoning FROM c AS ops""")
def rename_preview(spark, sf_dir):
    return rename.preview(rename.valid_operations(_ops(spark, sf_dir)))


@query(f"""WITH {RESOLVE_SQL}, last AS (SELECT * FROM ops WHERE ordinal % 7 <> 0 QUALIFY row_number() OVER (PARTITION BY input_filename ORDER BY ordinal DESC) = 1)
SELECT r.ordinal, r.source, r.target, CASE WHEN l.input_filename IS NULL THEN 'N/A' ELSE concat(round_even(l.confidence * 100, 0)::BIGINT, '%') END AS confidence,
CASE WHEN l.confidence >= 0.9 THEN 'green' WHEN l.confidence >= 0.7 THEN 'yellow' ELSE 'red' END AS colour,
CASE WHEN length(l.reasoning) > 50 THEN substr(l.reasoning, 1, 50) || '...' ELSE coalesce(l.reasoning, '') END AS reasoning
FROM resolved r LEFT JOIN last l ON l.input_filename = regexp_extract(r.source, '[^/]*$')""")
def rename_display(spark, sf_dir):
    ops = _ops(spark, sf_dir)
    return rename.display(rename.resolve(ops, rename.paths_with_names(_paths(spark, sf_dir))), ops.where("ordinal % 7 <> 0"))


@query(f"WITH {OPS_SQL} SELECT count(*) AS n_operations FROM ops")
def rename_length(spark, sf_dir):
    return rename.result_length(_ops(spark, sf_dir))


OUTCOME_SQL = f"""{RESOLVE_SQL},
touched AS (SELECT p, count(*) AS n FROM (SELECT source AS p FROM resolved UNION ALL SELECT target FROM resolved) GROUP BY 1),
have AS (SELECT DISTINCT path AS p FROM named WHERE page_id % 4 <> 3),
known AS (SELECT touched.p, n, have.p IS NOT NULL AS there FROM touched LEFT JOIN have USING (p)),
outcome AS (SELECT ordinal, source, target, CASE WHEN s.n > 1 OR g.n > 1 THEN 'sequential' WHEN NOT s.there THEN 'failed' WHEN g.there THEN 'failed' ELSE 'ok' END AS status, s.there AS s_there FROM resolved JOIN known s ON s.p = source JOIN known g ON g.p = target)"""


def _outcome(spark, sf_dir) -> DataFrame:
    paths = rename.paths_with_names(_paths(spark, sf_dir))
    return rename.planned_outcome(rename.resolve(_ops(spark, sf_dir), paths), paths.where("page_id % 4 <> 3"))


@query(f"WITH {OUTCOME_SQL} SELECT ordinal, source, target, status, CASE WHEN status = 'failed' THEN CASE WHEN NOT s_there THEN 'source does not exist' ELSE 'target already exists' END END AS error FROM outcome")
def rename_outcome(spark, sf_dir):
    return _outcome(spark, sf_dir)


@query(f"WITH {OUTCOME_SQL} SELECT count(*) FILTER (status = 'ok') AS success_count, count(*) FILTER (status = 'failed') AS failure_count, bool_and(status <> 'failed') AS all_succeeded FROM outcome")
def rename_counts(spark, sf_dir):
    return rename.outcome_counts(_outcome(spark, sf_dir))
