"""Named queries over the driver's tables, and the SQL that must give the same rows.

The driver has no word-processor files, so its tables stand in: a row of ``documents`` is a text
file, a conversation is a document with turns as pages, an order is a document with line items as
pages, a user's events are an edit or request log.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import formats, geometry, numbers
from quire.functions import text as T
from quire.operators import editing, lines, lookup, ordered, requests, search, sets, texts
from quire.plans import convert
from quire.sources import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: Phrases that the queries look for.
PHRASES = ["the th", "de la", "Ti on", "ünd", "absent phrase"]

# The SQL twin of ``normalize`` for text without letters whose lower case depends on their place.
_NORMAL = r"""lower(translate(replace(replace(replace(replace(replace(replace(replace(regexp_replace({0}, '[\s\x{{0B}}\x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}\x{{AD}}]', '', 'g'),
 'ﬀ', 'ff'), 'ﬁ', 'fi'), 'ﬂ', 'fl'), 'ﬃ', 'ffi'), 'ﬄ', 'ffl'), 'ﬅ', 'st'), 'ﬆ', 'st'), '‘’“”‐‑–—Σ', '''''""----σ'))"""


def normal(column: str) -> str:
    return _NORMAL.format(column)


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLE[f.__name__] = oracle
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def values(spark: SparkSession, rows: str, columns: str) -> DataFrame:
    return spark.sql(f"select * from values {rows} as t({columns})")


# Text files ---------------------------------------------------------------


@query("""
with t as (select doc_id, case when ends_with(text, chr(10)) then left(text, length(text) - 1) else text end as t from documents where text is not null
), l as (select doc_id, string_split(t, chr(10)) as l from t), p as (select doc_id, l, unnest(range(0, len(l)))::int as pos from l)
select doc_id, pos, case when ends_with(l[pos + 1], chr(13)) then left(l[pos + 1], length(l[pos + 1]) - 1) else l[pos + 1] end as text from p
""")
def text_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts.paragraphs(table(spark, sf_dir, "documents"), "doc_id", "text")


_UNIX = "replace((case when ends_with(text, chr(10)) then left(text, length(text) - 1) else text end) || chr(10), chr(13) || chr(10), chr(10))"


@query(f"select doc_id, {_UNIX} as text from documents where text is not null")
def text_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return texts.text_of(texts.paragraphs(docs, "doc_id", "text"), ["doc_id"])


@query("""
with e as (select page_id, lower(regexp_extract(url, '[^/]\\.([^./]*)/*$', 1)) as e from pages)
select page_id, case when e = 'pdf' then 'pdf' when e in ('doc', 'dot') then 'doc' when e in ('txt', 'text', 'md', 'markdown', 'log') then 'text' else 'docx' end as format from e
""")
def format_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", formats.format_of(F.col("url")).alias("format"))


@query(f"select doc_id, md5({normal('text')}) as digest, length({normal('text')})::int as n from documents")
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    norm = T.normalize(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(norm).alias("digest"), F.length(norm).alias("n"))


_PHRASES_SQL = ", ".join(f"('{p}', '{T.normalize_literal(p)}')" for p in PHRASES)


@query(f"""
with q(phrase, q) as (values {_PHRASES_SQL}), n as (select doc_id, {normal("text")} as t from documents)
select doc_id, phrase, ((length(t) - length(replace(t, q, ''))) / length(q))::int as n from n, q where contains(t, q)
""")
def match_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The text is normalised once, below the explosion into phrases.
    docs = table(spark, sf_dir, "documents").select("doc_id", T.normalize(F.col("text")).alias("t"))
    asked = F.array(*[F.struct(F.lit(p).alias("phrase"), F.lit(T.normalize_literal(p)).alias("q")) for p in PHRASES])
    counted = docs.select("doc_id", "t", F.explode(asked).alias("a"))
    return counted.select("doc_id", "a.phrase", T.count_in_normalized(F.col("t"), F.col("a.q")).alias("n")).where("n > 0")


@query(rf"""
with d as materialized (select doc_id, string_split(text, '') as l, {normal("text")} as t from documents where contains({normal("text")}, 'thth')
), s as materialized (select doc_id, list_filter(range(1, len(l) + 1), lambda i: length({normal("l[i]")}) > 0) as solid, list_transform(string_split(t, 'thth'), lambda s: length(s)) as p from d
), k as (select doc_id, solid, p, unnest(range(1, len(p)))::int as k from s
), a as (select doc_id, solid, k, (list_sum(p[1:k]) + 4 * (k - 1))::int as a from k)
select doc_id, (k - 1)::int as idx, (solid[a + 1] - 1)::int as "from", solid[a + 4]::int as "to" from a
""")
def match_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.search(table(spark, sf_dir, "documents"), "text", "TH th")
    return found.select("doc_id", F.posexplode(T.match_ranges(F.col("text"), "TH th")).alias("idx", "m")).select("doc_id", "idx", F.col("m.from").alias("from"), F.col("m.to").alias("to"))


@query(f"select conv_id, turn from conversations where contains({normal('text')}, 'thth')")
def search_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(table(spark, sf_dir, "conversations"), "text", "Th th").select("conv_id", "turn")


def _find_sql(forward: bool) -> str:
    away = "((p.turn - s.turn - 1) % n + n) % n" if forward else "((s.turn - p.turn - 1) % n + n) % n"
    return f"""
with n as (select conv_id, max(turn) + 1 as n from conversations group by conv_id
), p as (select conv_id, turn from conversations where contains({normal("text")}, 'ther')
), s as (select conv_id, turn from conversations)
select s.conv_id, s.turn as start, arg_min(p.turn, {away}) as page from s join n using (conv_id) join p using (conv_id) group by s.conv_id, s.turn
"""


def _find(spark: SparkSession, sf_dir: str, forward: bool) -> DataFrame:
    pages = table(spark, sf_dir, "conversations")
    starts = pages.select("conv_id", F.col("turn").alias("start")).distinct()
    return search.find_next(pages, ["conv_id"], "turn", "text", starts, "Th er", forward)


@query(_find_sql(True))
def find_next_fwd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _find(spark, sf_dir, True)


@query(_find_sql(False))
def find_next_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _find(spark, sf_dir, False)


@query("""
with m as (select conv_id, turn, row_number() over (partition by conv_id order by turn) r, count(*) over (partition by conv_id) n, first_value(turn) over (partition by conv_id order by turn) f,
  lead(turn) over (partition by conv_id order by turn) l from conversations where role = 'user')
select conv_id, turn, coalesce(l, f) as next_page, 0 as next_index from m
""")
def next_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    matches = table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", F.lit(0).alias("idx"))
    return search.next_in_page(matches, ["conv_id"], "turn", "idx").select("conv_id", "turn", "next_page", "next_index")


@query(f"select doc_id, item_id from (select doc_id, {normal('text')} t from documents) d join (select item_id, {normal('text')} q from benchmark) b on contains(t, q)")
def benchmark_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.containment(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "doc_id", "text", "item_id", "text")


@query(r"""
with t as (select conv_id, turn, text, lag(text) over (partition by conv_id order by turn) as p from conversations
), w as (select conv_id, turn, list_filter(regexp_split_to_array(lower(p), '[^\p{L}\p{N}]+'), lambda w: octet_length(encode(w)) > 2) as e,
  list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: octet_length(encode(w)) > 2) as g from t where p is not null)
select conv_id, turn, len(e)::int as n_expected, len(list_filter(e, lambda w: list_contains(g, w)))::int as n_found from w
""")
def word_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    pairs = table(spark, sf_dir, "conversations").withColumn("asked", before).where("asked is not null")
    return search.recall(pairs, "asked", "text").select("conv_id", "turn", "n_expected", "n_found")


# Counting and styles --------------------------------------------------------

_FORMATS = ["lowerLetter", "upperLetter", "lowerRoman", "upperRoman", "decimalZero", "ordinal", "decimal", "none"]


@query("""
with n as (select p_partkey % 4200 as n, p_partkey from part), f as (select unnest(['lowerLetter', 'upperLetter', 'lowerRoman', 'upperRoman', 'decimalZero', 'ordinal', 'decimal', 'none']) as format
), r as (select p_partkey, n, repeat('M', (n // 1000)::int) || (['', 'C', 'CC', 'CCC', 'CD', 'D', 'DC', 'DCC', 'DCCC', 'CM'])[n // 100 % 10 + 1] || (['', 'X', 'XX', 'XXX', 'XL', 'L', 'LX', 'LXX', 'LXXX', 'XC'])[n // 10 % 10 + 1]
  || (['', 'I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX'])[n % 10 + 1] as r, case when n = 0 then '' else repeat(chr((97 + (n - 1) % 26)::int), ((n - 1) // 26 + 1)::int) end as l from n)
select p_partkey, n, format, case format when 'lowerLetter' then l when 'upperLetter' then upper(l) when 'lowerRoman' then lower(r) when 'upperRoman' then r when 'decimalZero' then case when n < 10 then '0' || n else n::varchar end
  when 'ordinal' then n || case when n % 100 in (11, 12, 13) then 'th' when n % 10 = 1 then 'st' when n % 10 = 2 then 'nd' when n % 10 = 3 then 'rd' else 'th' end when 'decimal' then n::varchar else '' end as label
from r, f
""")
def number_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 4200).alias("n"), F.explode(F.array(*map(F.lit, _FORMATS))).alias("format"))
    return n.select("p_partkey", "n", "format", numbers.number(F.col("n"), F.col("format")).alias("label"))


@query("""
with i as (select conv_id, turn, case role when 'system' then 0 when 'user' then 1 else 2 end as level from conversations
), g as (select *, sum((level < 1)::int) over w as g1, sum((level < 2)::int) over w as g2, sum((level = 0)::int) over w as c0 from i window w as (partition by conv_id order by turn)
), c as (select *, sum((level = 1)::int) over (partition by conv_id, g1 order by turn) as c1, sum((level = 2)::int) over (partition by conv_id, g2 order by turn) + 2 as c2 from g)
select conv_id, turn, case level when 0 then c0 || '.' when 1 then c0 || '.' || chr((96 + c1)::int) || ')'
  else '(' || (['', 'i', 'ii', 'iii', 'iv', 'v', 'vi', 'vii', 'viii', 'ix', 'x', 'xi', 'xii'])[(c2 + 1)::int] || ')' end as label from c
""")
def list_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels = values(spark, "(7, 0, 'decimal', '%1.', 1), (7, 1, 'lowerLetter', '%1.%2)', 1), (7, 2, 'lowerRoman', '(%3)', 3)", "num, level, format, template, start")
    level = F.when(F.col("role") == "system", 0).when(F.col("role") == "user", 1).otherwise(2)
    items = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.lit(7).alias("num"), level.alias("level"))
    return ordered.list_labels(items, levels, ["conv_id"], "turn").select("conv_id", "turn", "label")


@query("""
with e as (select event_id, user_id, event_type in ('click', 'view') as foot, row_number() over (partition by user_id, event_type in ('click', 'view') order by ts, event_id) n from events)
select event_id, case when foot then n::varchar else lower(repeat('M', (n // 1000)::int) || (['', 'C', 'CC', 'CCC', 'CD', 'D', 'DC', 'DCC', 'DCCC', 'CM'])[n // 100 % 10 + 1]
  || (['', 'X', 'XX', 'XXX', 'XL', 'L', 'LX', 'LXX', 'LXXX', 'XC'])[n // 10 % 10 + 1] || (['', 'I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX'])[n % 10 + 1]) end as mark from e
""")
def note_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = table(spark, sf_dir, "events").withColumn("at", F.struct("ts", "event_id"))
    return ordered.note_numbers(refs, ["user_id"], "at", F.col("event_type").isin("click", "view")).select("event_id", "mark")


@query("select conv_id, turn, case when lag(role) over (partition by conv_id order by turn) = role and turn % 3 > 0 then 0.0 else 6.0 end::double as space_before from conversations")
def contextual_spacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    paragraphs = table(spark, sf_dir, "conversations").withColumns({"before": F.lit(6.0), "ask": F.col("turn") % 3 > 0})
    return ordered.contextual_spacing(paragraphs, ["conv_id"], "turn", "role", "before", "ask").select("conv_id", "turn", "space_before")


@query("""
with recursive s as (select c_nationkey as sheet, 'S' || c_custkey // 25 as id, 'S' || case c_custkey // 25 % 7 when 0 then null when 1 then c_custkey // 25 when 2 then c_custkey // 25 + 1 when 3 then c_custkey // 25 - 1 when 6 then -5 else c_custkey // 75 end as based,
  case when c_custkey % 3 = 0 then c_name end as font, case when c_custkey % 4 = 0 then (c_custkey % 30 + 6)::int end as size, case when c_custkey % 5 < 2 then c_custkey % 5 = 0 end as bold
  from (select *, row_number() over (partition by c_nationkey, c_custkey // 25 order by c_custkey) as k from customer) where k = 1
), c(sheet, id, anc, depth) as (select sheet, id, id, 0 from s union all select c.sheet, c.id, n.id, depth + 1 from c join s a on a.sheet = c.sheet and a.id = c.anc join s n on n.sheet = a.sheet and n.id = a.based and a.based <> a.id where depth < 16)
select c.sheet, c.id as style_id, coalesce(arg_min(font, depth) filter (font is not null), 'Arial') as font, coalesce(arg_min(size, depth) filter (size is not null), 12) as size,
  coalesce(arg_min(bold, depth) filter (bold is not null), false) as bold
from c join s on s.sheet = c.sheet and s.id = c.anc group by c.sheet, c.id
""")
def style_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as the styles of a sheet a nation: some based on themselves, on each other, or on none that is there."""
    k, style = F.col("c_custkey"), F.floor(F.col("c_custkey") / 25)
    named = lambda c: F.concat(F.lit("S"), c.cast("string"))
    first = F.row_number().over(Window.partitionBy("c_nationkey", style).orderBy("c_custkey"))
    based = F.when(style % 7 == 0, None).when(style % 7 == 1, style).when(style % 7 == 2, style + 1).when(style % 7 == 3, style - 1).when(style % 7 == 6, -5).otherwise(F.floor(k / 75))
    styles = table(spark, sf_dir, "customer").withColumn("k", first).where("k = 1").select(
        F.col("c_nationkey").alias("sheet"), named(style).alias("style_id"), named(based).alias("based_on"), F.when(k % 3 == 0, F.col("c_name")).alias("font"), F.when(k % 4 == 0, (k % 30 + 6).cast("int")).alias("size"), F.when(k % 5 < 2, k % 5 == 0).alias("bold")
    )
    return lookup.cascade(styles, ["font", "size", "bold"], {"font": "Arial", "size": 12, "bold": False}, ["sheet"])


# Geometry ---------------------------------------------------------------------


def _pages(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """Line items numbered within their order; ``dealt`` ones stay in all partitions, for work that takes long by the bytes of its rows."""
    items = table(spark, sf_dir, "lineitem")
    if dealt:
        items = items.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "l_orderkey")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate")
    return items.withColumn("page", F.row_number().over(w) - 1)


_PAGES_SQL = "select *, (row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) - 1)::int as page from lineitem"
_TOPS_SQL = "select *, 24.0::double + coalesce(sum(round(l_quantity * 1.5) + 18) over (partition by l_orderkey order by page rows between unbounded preceding and 1 preceding), 0) as top from p"


@query(f"with p as ({_PAGES_SQL}) select l_orderkey, page, top from ({_TOPS_SQL})")
def page_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.page_offsets(_pages(spark, sf_dir), ["l_orderkey"], "page", "l_quantity", 1.5).select("l_orderkey", "page", "top")


@query(f"""
with p as ({_PAGES_SQL}), t as ({_TOPS_SQL}), y as (select l_orderkey, page as look, l_extendedprice / 100 as y from p)
select y.l_orderkey, look, coalesce(max(t.page) filter (t.top <= y.y), 0)::int as page from y join t using (l_orderkey) group by y.l_orderkey, look
""")
def page_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _pages(spark, sf_dir)
    tops = ordered.page_offsets(pages, ["l_orderkey"], "page", "l_quantity", 1.5)
    looks = pages.select("l_orderkey", F.col("page").alias("look"), (F.col("l_extendedprice") / 100).alias("y"))
    return ordered.page_at(tops, looks, ["l_orderkey"], "page", "y").select("l_orderkey", "look", "page")


@query("""
with p as (select conv_id, turn::int as turn, (max(turn) over (partition by conv_id) + 1)::int as n from conversations)
select conv_id, turn, (turn // 2 * 2)::int as start, least(turn // 2 * 2 + 2, n)::int as "end",
  (case when turn < 1 then 0 else 1 + (turn - 1) // 2 * 2 end)::int as cover_start, (case when turn < 1 then least(1, n) else least(1 + (turn - 1) // 2 * 2 + 2, n) end)::int as cover_end from p
""")
def spreads(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = (F.max("turn").over(Window.partitionBy("conv_id")) + 1).cast("int")
    pages = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("int").alias("turn"), n.alias("n"))
    both = pages.withColumns({"a": geometry.spread_of(2, False, F.col("turn"), F.col("n")), "b": geometry.spread_of(2, True, F.col("turn"), F.col("n"))})
    return both.select("conv_id", "turn", "a.*", F.col("b.start").alias("cover_start"), F.col("b.end").alias("cover_end"))


_GRID_SQL = """
with g as (select p_partkey, floor(612.0 * p_size)::bigint as width, floor(792.0 * p_size)::bigint as height from part
), f as (select *, width::double * height <= 24000000 and width <= 16384 and height <= 16384 as fits from g
), t as (select *, case when fits then 1 else ceil(width / 1024) end::int as cols, case when fits then 1 else ceil(height / 1024) end::int as rows, case when fits then width else 1024 end as tile_w, case when fits then height else 1024 end as tile_h from f)
"""


@query(_GRID_SQL + "select p_partkey, width, height, cols, rows, tile_w::bigint as tile_w, tile_h::bigint as tile_h from t")
def tile_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = geometry.grid(F.lit(612.0), F.lit(792.0), F.col("p_size").cast("double"))
    return table(spark, sf_dir, "part").select("p_partkey", g.alias("g")).select("p_partkey", "g.*").withColumns({c: F.col(c).cast("long") for c in ("tile_w", "tile_h")})


@query(_GRID_SQL + """, s as (select *, least(floor(floor(0.25 * width) / tile_w), cols - 1)::int c0, least(floor(floor(0.5 * width) / tile_w), cols - 1)::int c1, least(floor(floor(0.1 * height) / tile_h), rows - 1)::int r0, least(floor(floor(0.3 * height) / tile_h), rows - 1)::int r1 from t
), e as (select *, unnest(range(r0, r1 + 1))::int as row from s), c as (select *, unnest(range(c0, c1 + 1))::int as col from e)
select p_partkey, col, row, (col * tile_w)::bigint as x, (row * tile_h)::bigint as y, least(tile_w, width - col * tile_w)::bigint as w, least(tile_h, height - row * tile_h)::bigint as h from c
""")
def tiles_over(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "part").select("p_partkey", geometry.grid(F.lit(612.0), F.lit(792.0), F.col("p_size").cast("double")).alias("g"))
    over = geometry.tiles_over(F.col("g"), F.lit(0.25), F.lit(0.5), F.lit(0.1), F.lit(0.3))
    tiles = g.select("p_partkey", "g", F.explode(over).alias("t"))
    r = geometry.tile_rect(F.col("g"), F.col("t.col"), F.col("t.row"))
    at = tiles.select("p_partkey", "t.col", "t.row", r.alias("r"))
    return at.select("p_partkey", "col", "row", *[F.col(f"r.{a}").cast("long").alias(b) for a, b in (("x", "x"), ("y", "y"), ("width", "w"), ("height", "h"))])


@query(f"""
with p as ({_PAGES_SQL}), h as (select l_orderkey, page, (l_extendedprice * 10000)::bigint as bytes from p where page between 0 and 5
), s as (select *, page between 1 and 2 as shown, abs(page - 1) as far, sum(bytes) over (partition by l_orderkey) as total from h
), g as (select *, coalesce(sum(case when shown then 0 else bytes end) over (partition by l_orderkey order by far desc, page rows between unbounded preceding and 1 preceding), 0) as gone from s)
select l_orderkey, page from g where shown or total - gone <= 402653184
""")
def evict_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = _pages(spark, sf_dir).select("l_orderkey", "page", F.round(F.col("l_extendedprice") * 10000).cast("long").alias("bytes"), F.lit(1).alias("first"), F.lit(2).alias("last"))
    return ordered.evict(held, ["l_orderkey"], "page", "bytes", "first", "last", 3).select("l_orderkey", "page")


@query(f"""
with p as ({_PAGES_SQL}), t as (select l_orderkey, page, l_quantity as w, sum(l_quantity) over (partition by l_orderkey) as g, count(*) over (partition by l_orderkey) as n from p
), c as (select *, case when g > 1 then w * greatest(least(g, 120.0), 12.0) / g else greatest(120.0, 12.0) / n end as cw from t)
select l_orderkey, page, round(cw, 6) as column_width, round(coalesce(sum(cw) over (partition by l_orderkey order by page rows between unbounded preceding and 1 preceding), 0), 6) as x from c
""")
def table_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = ordered.columns(_pages(spark, sf_dir), ["l_orderkey"], "page", "l_quantity", 120.0)
    return placed.select("l_orderkey", "page", F.round("column_width", 6).alias("column_width"), F.round("x", 6).alias("x"))


@query(f"""
with p as ({_PAGES_SQL}) select l_orderkey, string_agg(replace(l_returnflag || chr(10) || l_linestatus, chr(10), ' ') || chr(9) || l_linenumber, chr(10) order by page) || chr(10) as text from p group by l_orderkey
""")
def table_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pages(spark, sf_dir).select("l_orderkey", F.col("page").alias("row"), F.posexplode(F.array(F.concat_ws("\n", "l_returnflag", "l_linestatus"), F.col("l_linenumber").cast("string"))).alias("col", "text"))
    return texts.table_text(rows, ["l_orderkey"])


@query("""
with r as (select conv_id, turn, role, text, coalesce(role is distinct from lag(role) over w, true) as new from conversations window w as (partition by conv_id order by turn)
), g as (select *, sum(new::int) over (partition by conv_id order by turn) as run from r)
select conv_id, run::bigint as run, any_value(role) as format, string_agg(text, '|' order by turn) as text from g group by conv_id, run
""")
def run_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return ordered.coalesce_runs(runs, ["conv_id"], "turn", "role", "text", "|")


# Combining and comparing --------------------------------------------------------


@query("select 0 as file_no, doc_id as pos, md5(text) as digest from documents union all select 1, conv_id * 1000 + turn, md5(text) from conversations")
def combine_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pos"), F.md5("text").alias("digest"))
    b = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("pos"), F.md5("text").alias("digest"))
    return sets.combine([a, b], ["pos"])


@query("""
with t as (select o_orderpriority as f, max(o_custkey) as top from orders group by 1), b as (select f, coalesce(sum(top + 1) over (order by f rows between unbounded preceding and 1 preceding), 0) as base from t)
select o_orderkey, (o_custkey + base)::bigint as new_id from orders join b on f = o_orderpriority
""")
def rebase_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.rebase_ids(table(spark, sf_dir, "orders"), "o_orderpriority", "o_custkey").select("o_orderkey", "new_id")


@query("select n_nationkey as style_id, n_name as name from nation union all select r_regionkey + 22, r_name from region where r_regionkey + 22 not in (select n_nationkey from nation)")
def styles_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    ours = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("style_id"), F.col("n_name").alias("name"))
    theirs = table(spark, sf_dir, "region").select((F.col("r_regionkey") + 22).alias("style_id"), F.col("r_name").alias("name"))
    return sets.first_wins(ours, theirs, "style_id")


@query("select doc_id, md5(text) as fingerprint, min(doc_id) over (partition by md5(text)) as read_at from documents")
def fingerprint_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.fingerprints(table(spark, sf_dir, "documents"), "doc_id", F.col("text"))


@query("""
with o as (select conv_id, turn as pos, text as a from conversations), n as (select conv_id, turn + case when turn > 4 then 100 else 0 end as pos, case when role = 'user' then upper(text) else text end as b from conversations where turn <> 1)
select coalesce(o.conv_id, n.conv_id) as conv_id, coalesce(o.pos, n.pos) as pos, case when n.conv_id is null then 'gone' when o.conv_id is null then 'block' when a is not distinct from b then 'keep' else 'para' end as action
from o full join n on o.conv_id = n.conv_id and o.pos = n.pos
""")
def save_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "conversations")
    new = old.where("turn <> 1").select("conv_id", (F.col("turn") + F.when(F.col("turn") > 4, 100).otherwise(0)).alias("turn"), F.when(F.col("role") == "user", F.upper("text")).otherwise(F.col("text")).alias("text"))
    return sets.save_diff(old, new, ["conv_id"], "turn", "text")


# Logs of edits and requests --------------------------------------------------------


@query("""
with e as (select user_id, event_id, ts, event_type, (value * 10)::bigint // 50 as pos, row_number() over (partition by user_id order by ts, event_id) n from events
), j as (select *, case when (lag(pos) over w) + 1 = pos and lag(event_type) over w <> 'view' and event_type <> 'view' then 0 else 1 end as new from e window w as (partition by user_id order by n)
), s as (select *, sum(new) over (partition by user_id order by n) as step from j)
select user_id, event_id, step::bigint as step from (select *, max(step) over (partition by user_id) as m from s) where step > m - 500
""")
def undo_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.floor(F.round(F.col("value") * 10).cast("long") / 50)
    ops = table(spark, sf_dir, "events").select("user_id", "event_id", F.struct("ts", "event_id").alias("seq"), at.alias("at"), F.when(F.col("event_type") != "view", F.lit("x")).alias("typed"))
    return ordered.undo_groups(ops, ["user_id"], "seq", "at", "typed", keep=500).select("user_id", "event_id", "step")


@query("select user_id, arg_max(event_id, (ts, event_id)) as event_id, arg_max(event_type, (ts, event_id)) as event_type from events group by user_id")
def latest_request(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests.latest(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], ["event_id", "event_type"])


@query("select user_id, event_id, place from (select user_id, event_id, row_number() over (partition by user_id order by ts desc, event_id desc)::int as place from events) where place <= 16")
def lifo_waiting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests.newest_first(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], 16).select("user_id", "event_id", "place")


@query("select event_id from (select event_id, date_trunc('day', ts) as g, max(date_trunc('day', ts)) over (partition by user_id) as m from events) where g = m")
def generation_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("generation", F.date_trunc("day", "ts"))
    return requests.newest_generation(events, ["user_id"], "generation").select("event_id")


# Outlines and annotations ----------------------------------------------------------

_HEADINGS = "(1, 0, 1), (1, 1, 2), (1, 2, 3), (1, 3, 2), (1, 4, 1), (1, 5, 3), (2, 0, 3), (2, 1, 2), (2, 2, 4)"


@query(f"""
with h(doc, pos, level) as (values {_HEADINGS})
select doc, pos, (select max(p.pos) from h p where p.doc = h.doc and p.pos < h.pos and p.level < h.level and not exists (
  select 1 from h q where q.doc = h.doc and q.pos > p.pos and q.pos < h.pos and q.level < h.level))::bigint as parent from h
""")
def heading_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.heading_parents(values(spark, _HEADINGS, "doc, pos, level"), ["doc"], "pos", "level").select("doc", "pos", F.col("parent").cast("long").alias("parent"))


@query("""
select event_id, case event_type when 'click' then 'Note' when 'view' then 'Highlight' else 'Text' end as kind, least(greatest((100.0 - greatest(value, 50.0)) / 100.0, 0), 1)::double as y_fraction
from events where event_type <> 'purchase'
""")
def annotation_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    subtype = F.when(F.col("event_type") == "click", "Text").when(F.col("event_type") == "view", "Highlight").when(F.col("event_type") == "purchase", "Link").otherwise("FreeText")
    annots = table(spark, sf_dir, "events").select("event_id", subtype.alias("subtype"), F.lit(0.0).alias("x0"), F.col("value").alias("y0"), F.lit(9.0).alias("x1"), F.lit(50.0).alias("y1"), F.lit(" x ").alias("contents"), F.lit(100.0).alias("height"))
    return sets.annotations(annots, "height").select("event_id", "kind", "y_fraction")


@query("with v as (select l_orderkey, (l_quantity % 4)::int as turn, count(*) n from lineitem group by 1, 2) select l_orderkey, arg_max(turn, (n, -turn)) as turn from v group by 1")
def dominant_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    chars = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_quantity").cast("int").alias("turn"))
    return lines.dominant_turn(chars, ["l_orderkey"], "turn")


@query("select l_orderkey, min(l_quantity) as x0, min(l_discount) as y0, max(l_extendedprice) as x1, max(l_tax) as y1 from lineitem group by 1")
def bounding_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_quantity").alias("x0"), F.col("l_discount").alias("y0"), F.col("l_extendedprice").alias("x1"), F.col("l_tax").alias("y1"))
    return lines.bounding_box(boxes, ["l_orderkey"])


@query("select l_orderkey, l_linenumber, (((l_quantity::int * 90 - l_partkey * 45) % 360 + 360) % 360)::bigint as turn from lineitem")
def rotate_mod(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", geometry.turned(F.col("l_quantity").cast("int") * 90, -F.col("l_partkey") * 45).alias("turn"))


@query("""
with c as (select p_partkey, p_partkey % 256 as r, p_size * 5 as g, p_partkey * 7 % 256 as b from part
), i(i, x, y, z) as (values (1, 0, 0, 0), (2, 0, 0, 255), (3, 0, 255, 255), (4, 0, 255, 0), (5, 255, 0, 255), (6, 255, 0, 0), (7, 255, 255, 0), (8, 255, 255, 255), (9, 0, 0, 128), (10, 0, 128, 128), (11, 0, 128, 0), (12, 128, 0, 128), (13, 128, 0, 0), (14, 128, 128, 0), (15, 192, 192, 192))
select p_partkey, arg_min(i, ((r - x) * (r - x) + (g - y) * (g - y) + (b - z) * (b - z), i)) as colour from c, i group by p_partkey
""")
def nearest_colour(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = formats.nearest_indexed(F.col("p_partkey") % 256, F.col("p_size") * 5, F.col("p_partkey") * 7 % 256)
    return table(spark, sf_dir, "part").select("p_partkey", c.alias("colour"))


@query("select event_id, 'D:' || strftime(ts, '%Y%m%d%H%M%S') || 'Z' as stamp from events")
def pdf_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", formats.pdf_date(F.col("ts")).alias("stamp"))


@query(f"""
with p as ({_PAGES_SQL}), s as (select l_orderkey, page, (page * 100)::bigint as "start", (page * 100 + l_quantity)::bigint as "end", l_partkey as value from p
), a as (select l_orderkey, page, (page * 100 + l_linenumber * 10)::bigint as at from p)
select a.l_orderkey, a.page, s.value from a left join s on a.l_orderkey = s.l_orderkey and a.at >= s."start" and a.at < s."end"
""")
def interval_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _pages(spark, sf_dir)
    spans = pages.select("l_orderkey", (F.col("page") * 100).cast("long").alias("start"), (F.col("page") * 100 + F.col("l_quantity")).cast("long").alias("end"), F.col("l_partkey").alias("value"))
    at = pages.select("l_orderkey", "page", (F.col("page") * 100 + F.col("l_linenumber") * 10).cast("long").alias("at"))
    return lookup.interval_lookup(spans, at, ["l_orderkey"], "at").select("l_orderkey", "page", "value")


@query(f"""
with p as ({_PAGES_SQL}), k as (select l_orderkey, page, case when page = 2 then 0 when page between 1 and 3 then 1 else 2 end as kind, case when page < 1 then 1 - page when page > 3 then page - 3 else 0 end as far from p)
select l_orderkey, page, row_number() over (partition by l_orderkey order by kind, far, case when page > 3 then 0 else 1 end, page)::int as turn from k where kind < 2 or far <= 2
""")
def draw_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _pages(spark, sf_dir).select("l_orderkey", "page", F.lit(2).alias("current"), F.lit(1).alias("first"), F.lit(3).alias("last"))
    return ordered.draw_order(pages, ["l_orderkey"], "page", "current", "first", "last", 2).select("l_orderkey", "page", "turn")


@query(f"""
with p as ({_PAGES_SQL}) select l_orderkey, page, coalesce(sum(l_quantity + 6) over (partition by l_orderkey order by page rows between unbounded preceding and 1 preceding), 0)::double as x,
  (max(l_discount) over (partition by l_orderkey) - l_discount) / 2 as y from p
""")
def place_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.place_row(_pages(spark, sf_dir), ["l_orderkey"], "page", "l_quantity", "l_discount").select("l_orderkey", "page", "x", "y")


@query("select conv_id, turn, last_value(case when role = 'system' then turn end ignore nulls) over (partition by conv_id order by turn) as header, min(case when role = 'assistant' then turn end) over (partition by conv_id order by turn rows between current row and unbounded following) as owner from conversations")
def inherited_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.when(F.col("role") == "system", F.col("turn")).alias("header"))
    filled = ordered.inherit_section(turns, ["conv_id"], "turn", ["header"])
    return ordered.owner_of_hidden(filled, ["conv_id"], "turn", F.col("role") == "assistant").select("conv_id", "turn", "header", "owner")


# Scalars over columns that stand in for names, titles, lengths and colours ------------------


@query("""
with t as (select doc_id, trim(string_split(text, chr(10))[1]) as t from documents)
select doc_id, case when not (t = '' or lower(t) in ('untitled', 'untitled document', 'microsoft word', 'document') or starts_with(lower(t), 'microsoft word - ')) then t end as title from t
""")
def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", formats.title(F.split("text", "\n")[0]).alias("title"))


@query(r"""
with f as (select p_partkey, p_name || ' ' || p_type as f, lower(p_name || ' ' || p_type) as l from part)
select p_partkey, f || ',' || case when regexp_matches(l, 'mono|courier|consol|code|typewriter') then 'monospace'
  when regexp_matches(l, 'times|georgia|cambria|garamond|serif|roman|book|palatino|minion') and not contains(l, 'sans') then 'serif' else 'sans-serif' end as family from f
""")
def font_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", formats.font_family(F.concat_ws(" ", "p_name", "p_type")).alias("family"))


@query("""
select n_nationkey, case when upper(left(n_name, 2)) in ('US', 'CA', 'MX', 'CL', 'CO', 'VE', 'PH', 'PR', 'GT', 'CR', 'PA', 'DO', 'SV', 'NI', 'BZ') then 'letter' else 'a4' end as paper from nation
""")
def local_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    locale = F.concat(F.lit("xx_"), F.lower(F.substring("n_name", 1, 2)), F.lit(".UTF-8@euro"))
    return table(spark, sf_dir, "nation").select("n_nationkey", formats.paper(locale).alias("paper"))


@query("""
with u as (select l_orderkey, l_linenumber, l_quantity, case l_returnflag when 'A' then 'pt' when 'N' then 'in' else 'em' end as u from lineitem)
select l_orderkey, l_linenumber, case u when 'pt' then (l_quantity * 12700)::bigint when 'in' then (l_quantity * 914400)::bigint end as emu from u
""")
def css_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = F.when(F.col("l_returnflag") == "A", "pt").when(F.col("l_returnflag") == "N", "in").otherwise("em")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", formats.css_length_emu(F.concat(F.col("l_quantity").cast("string"), unit)).alias("emu"))


@query("select p_partkey, case when p_size % 7 > 0 then (p_partkey * 977 % 16777216)::int end as colour from part")
def colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("p_size") % 7 > 0, F.lpad(F.hex(F.col("p_partkey") * 977 % 16777216), 6, "0")).otherwise("auto")
    return table(spark, sf_dir, "part").select("p_partkey", formats.colour(text).alias("colour"))


@query("""
with t as (select page_id, case page_id % 3 when 0 then '../media/./' || url when 1 then '/abs/' || url else url || '/../../x' end as t from pages where url is not null)
select page_id, case when starts_with(t, '/') then substr(t, 2) else array_to_string(list_reduce(list_prepend(['word'], list_transform(string_split(t, '/'), lambda s: [s])),
  lambda a, x: case when x[1] = '..' then a[1:len(a) - 1] when x[1] in ('', '.') then a else list_concat(a, x) end), '/') end as part from t
""")
def resolved_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, url = F.col("page_id") % 3, F.col("url")
    target = F.when(k == 0, F.concat(F.lit("../media/./"), url)).when(k == 1, F.concat(F.lit("/abs/"), url)).otherwise(F.concat(url, F.lit("/../../x")))
    return table(spark, sf_dir, "pages").where("url is not null").select("page_id", formats.resolve_path(F.lit("word/"), target).alias("part"))


@query("select l_orderkey, l_linenumber, case when l_quantity < 0 or l_quantity > 50 then null when l_quantity < 50 * (1.0 / 3) then 'previous' when l_quantity > 50 * (1 - 1.0 / 3) then 'next' end as turn from lineitem")
def tap_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", geometry.tap_turn(F.col("l_quantity"), F.lit(50.0)).alias("turn"))


# Edits, notes and selections -----------------------------------------------------------------


@query("select conv_id, turn, case when length(text) > 4 then substr(text, 2, 2) || '++' || substr(text, 4) else text end as text from conversations")
def undo_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    long = turns.where(F.length("text") > 4)
    log = long.selectExpr("conv_id", "turn", "1 as seq", "'delete' as op", "0 as at", "substr(text, 1, 1) as content").unionByName(long.selectExpr("conv_id", "turn", "2 as seq", "'insert' as op", "2 as at", "'++' as content"))
    return editing.replay(turns, log, ["conv_id", "turn"], "text", "seq")


@query("""
select conv_id, turn, (case when turn = 1 then 5 else 0 end)::int as "from", (case when turn = 3 then least(10, length(text)) else length(text) end)::int as "to" from conversations
where turn between 1 and 3 and (case when turn = 1 then 5 else 0 end) < (case when turn = 3 then least(10, length(text)) else length(text) end)
""")
def selections(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").alias("n"))
    return editing.selection(pages, "turn", "n", (3, 10), (1, 5)).select("conv_id", "turn", "from", "to")


@query("""
with p as (select user_id, event_type, (row_number() over (partition by user_id order by ts, event_id) - 1)::int as pos from events
), r as (select user_id, pos, pos - row_number() over (partition by user_id order by pos) as run from p where event_type <> 'click')
select user_id, min(pos)::int as start, (max(pos) + 1)::int as "end" from r group by user_id, run
""")
def toggled_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    chars = table(spark, sf_dir, "events").select("user_id", at.alias("pos"), (F.col("event_type") == "click").alias("bold"))
    return editing.toggled_ranges(chars, ["user_id"], "pos", "bold", True)


@query("""
select r.conv_id, r.turn as note_id, coalesce(n.text, '') as body from conversations r
left join (select conv_id, turn, text from conversations where role <> 'system' and turn % 2 = 1) n on n.conv_id = r.conv_id and n.turn = r.turn
""")
def notes_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    notes = turns.where("turn % 2 = 1").select("conv_id", F.col("turn").alias("note_id"), F.when(F.col("role") == "system", "separator").alias("type"), "text")
    return lookup.notes_of(turns.select("conv_id", F.col("turn").alias("note_id")), notes, ["conv_id"]).select("conv_id", "note_id", "body")


@query("select l_orderkey, max(page)::int as page from (" + _PAGES_SQL + ") where 20 between l_quantity - 10 and l_quantity + 10 and 5 between page and page + 5 group by l_orderkey")
def annotation_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = _pages(spark, sf_dir).select("l_orderkey", "page", (F.col("l_quantity") - 10).alias("x0"), (F.col("l_quantity") + 10).alias("x1"), F.col("page").alias("y0"), (F.col("page") + 5).alias("y1"))
    return editing.topmost(boxes, ["l_orderkey"], "page", 20.0, 5.0)


@query(f"select doc_id, md5({_UNIX}) as digest from documents where text is not null")
def convert_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a text file, turned into a package and back."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    found = docs.select(F.col("doc_id").cast("string").alias("path"), F.encode("text", "UTF-8").alias("content"), F.lit("text").alias("format"))
    made = convert.convert(found, "docx").select("path", "content", F.lit("docx").alias("format"))
    back = convert.convert(tables.saved(made, "packages"), "text")  # as files between two programs
    return back.select(F.col("path").cast("long").alias("doc_id"), F.md5("content").alias("digest"))
