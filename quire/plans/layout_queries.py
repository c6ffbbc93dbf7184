"""Queries of predicates, lookups, glyph lines, looks, logs and scalars over the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import formats, geometry, numbers
from quire.functions import text as T
from quire.operators import editing, lines, lookup, looks, ordered, requests, search, sets, texts
from quire.plans.queries import _PAGES_SQL, _pages, query, table, values

# Bytes and names ------------------------------------------------------------


@query("""
with c as (select p_partkey, p_partkey % 7 as k, p_name as n from part)
select p_partkey, case k when 0 then null when 1 then 'pdf' when 2 then 'docx' when 3 then null else 'text' end as format,
  case k when 3 then 'tiff' when 4 then 'png' when 5 then 'jpeg' when 6 then 'gif' end as picture, case k when 3 then 'image/tiff' when 4 then 'image/png' when 5 then 'image/jpeg' when 6 then 'image/gif' else 'application/octet-stream' end as mime, k = 3 as tiff, k not in (0, 3) as is_text from c
""")
def byte_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents with the marks of several formats, told apart by their first bytes."""
    heads = ["00", "255044462D312E", "504B", "49492A00", "89504E47", "FFD8FF", "47494638"]
    content = F.concat(F.unhex(F.element_at(F.array(*map(F.lit, heads)), (F.col("p_partkey") % 7 + 1).cast("int"))), F.encode("p_name", "UTF-8"))
    found = table(spark, sf_dir, "part").select("p_partkey", content.alias("c"))
    return found.select("p_partkey", formats.sniff(F.col("c")).alias("format"), formats.picture_type(F.col("c")).alias("picture"), formats.picture_mime(F.col("c")).alias("mime"), formats.is_tiff(F.col("c")).alias("tiff"), formats.is_text(F.col("c")).alias("is_text"))


@query("""
select p_partkey, p_name || ' é€ ' || p_type as utf8, p_name || ' é€ ' || p_type as utf16, p_name || ' é€' as cp1252 from part
""")
def decoded_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One text in three encodings: with a UTF-8 mark, as UTF-16 with its mark, and as Windows-1252."""
    whole = F.concat_ws(" ", "p_name", F.lit("é€"), "p_type")
    utf8, utf16 = F.concat(F.unhex(F.lit("EFBBBF")), F.encode(whole, "UTF-8")), F.concat(F.unhex(F.lit("FFFE")), F.encode(whole, "UTF-16LE"))
    cp = F.concat(F.encode("p_name", "UTF-8"), F.unhex(F.lit("20E980")))
    return table(spark, sf_dir, "part").select("p_partkey", T.decode_text(utf8).alias("utf8"), T.decode_text(utf16).alias("utf16"), T.decode_text(cp).alias("cp1252"))


@query("select p_partkey, case p_size % 4 when 0 then 'pdf' when 1 then 'docx' when 2 then 'doc' else 'txt' end as ext, p_size % 3 = 0 as tiff_name from part")
def format_extensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    fmt = F.element_at(F.array(*map(F.lit, ["pdf", "docx", "doc", "text"])), F.col("p_size") % 4 + 1)
    name = F.concat("p_name", F.when(F.col("p_size") % 3 == 0, ".TIFF").otherwise(".tif.png"))
    return table(spark, sf_dir, "part").select("p_partkey", formats.extension(fmt).alias("ext"), formats.is_tiff_name(name).alias("tiff_name"))


@query("""
select event_id, hex(encode(replace(replace(event_type || ' ' || props, chr(10), chr(11)), chr(9), chr(9)))) as ascii_hex from events
""")
def utf16_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as a Word 97 stream holds them, decoded again to compare."""
    units = T.utf16_units(F.concat_ws(" ", "event_type", "props"))
    return table(spark, sf_dir, "events").select("event_id", F.hex(F.encode(F.decode(units, "UTF-16LE"), "UTF-8")).alias("ascii_hex"))


@query(r"""
with t as (select p_partkey, p_name || ' (' || p_type || ')\' as t from part)
select p_partkey, upper(hex(encode(t))) as ansi, '(' || replace(replace(replace(t, '\', '\\'), '(', '\('), ')', '\)') || '\351\200)' as literal,
  regexp_replace(trim(replace(p_name, ' ', '  ')), '\s+', ' ', 'g') || ' •' as shown from t join part using (p_partkey)
""")
def pdf_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts in a standard font's encoding, as PDF literals, and read back from PDF's own encoding."""
    t = F.concat("p_name", F.lit(" ("), "p_type", F.lit(")\\"))
    raw = F.concat(F.unhex(F.lit("20")), F.encode(F.replace("p_name", F.lit(" "), F.lit("  ")), "UTF-8"), F.unhex(F.lit("2080")))
    return table(spark, sf_dir, "part").select("p_partkey", T.win_ansi(t).alias("ansi"), T.pdf_string(F.concat(t, F.lit("é€"))).alias("literal"), T.pdf_text(raw).alias("shown"))


@query("select p_partkey, case p_size % 4 when 0 then '▪' when 1 then '•' when 2 then '◦' else '•' end as bullet from part")
def bullets(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = F.element_at(F.array(*map(F.lit, ["", "", "o", ""])), F.col("p_size") % 4 + 1)
    return table(spark, sf_dir, "part").select("p_partkey", numbers.bullets(marks).alias("bullet"))


@query("""
with s as (select p_partkey, p_size, case p_size % 6 when 0 then 'Title' when 1 then 'heading ' || (p_size % 9) when 2 then 'IntenseQuote' when 3 then 'List Bullet' when 4 then 'Body' end as id, case when p_size % 5 = 0 then p_size % 10 end as o from part
), k as (select *, case when id = 'Title' then 'title' when starts_with(id, 'heading') then 'heading' when id = 'IntenseQuote' then 'quote' when id = 'List Bullet' then 'list' when o between 0 and 8 then 'heading' else 'normal' end as kind from s
), l as (select *, case when kind <> 'heading' then 0 when id is not null and starts_with(id, 'heading') then least(greatest(p_size % 9, 1), 6) else least(o + 1, 6) end::int as level from k)
select p_partkey, kind, level, case kind when 'title' then 'Title' when 'heading' then 'Heading' || level when 'list' then 'ListParagraph' when 'quote' then 'Quote' end as style,
  case kind when 'heading' then 'h' || level when 'list' then 'list0' when 'normal' then 'body' else kind end as tag from l
""")
def paragraph_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of paragraphs by style ids and outline levels, their built-in styles and the editor's tags, read back."""
    n = F.col("p_size") % 6
    ident = F.when(n == 0, "Title").when(n == 1, F.concat(F.lit("heading "), (F.col("p_size") % 9).cast("string"))).when(n == 2, "IntenseQuote").when(n == 3, "List Bullet").when(n == 4, "Body")
    found = table(spark, sf_dir, "part").select("p_partkey", formats.style_kind(ident, F.when(F.col("p_size") % 5 == 0, F.col("p_size") % 10)).alias("k"))
    tag = formats.style_tag(F.col("k.kind"), F.col("k.level"))
    back = formats.style_of_tag(tag)
    return found.select("p_partkey", back["kind"].alias("kind"), back["level"].alias("level"), formats.style_id(F.col("k.kind"), F.col("k.level")).alias("style"), tag.alias("tag"))


@query("""
select event_id, not (event_type = 'click') as on_plain, not (event_type in ('click', 'purchase')) as on_style,
  case event_type when 'view' then 'page' when 'signup' then 'pages' when 'purchase' then 'pages' end as field from events
""")
def toggles_and_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("event_type")
    value = F.when(t == "click", "0").when(t == "purchase", "off").when(t == "view", "true")
    code = F.when(t == "view", " page \\* MERGEFORMAT").when(t == "signup", "NUMPAGES").when(t == "purchase", "SectionPages").otherwise("DATE")
    return table(spark, sf_dir, "events").select("event_id", formats.toggle(value).alias("on_plain"), formats.toggle(value, ("false", "0", "none", "off")).alias("on_style"), formats.field_kind(code).alias("field"))


@query("""
select p_partkey, case when p_size % 3 = 0 then p_size::varchar when p_size % 3 = 1 then null end as sz, case when p_size % 2 = 0 then '' end as strike, p_brand as font, case when p_size % 4 > 0 then lpad(hex(p_partkey % 1000), 6, '0') end as colour from part
""")
def run_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_size")
    sz = F.when(n % 3 == 0, F.concat(F.lit('<w:szCs w:val="7"/><w:sz w:val="'), n.cast("string"), F.lit('"/>'))).when(n % 3 == 1, '<w:sz w:val="auto"/>').otherwise('<w:szCs w:val="3"/>')
    strike = F.when(n % 2 == 0, "<w:strike/>").otherwise('<w:strike w:val="false"/>')
    font = F.concat(F.lit('<w:rFonts w:cs="x" '), F.when(n % 2 == 0, "w:ascii").otherwise("w:hAnsi"), F.lit('="'), "p_brand", F.lit('"/>'))
    colour = F.concat(F.lit('<w:color w:val="'), F.when(n % 4 > 0, F.lpad(F.hex(F.col("p_partkey") % 1000), 6, "0")).otherwise("auto"), F.lit('"/>'))
    props = F.concat(font, strike, colour, sz)
    return table(spark, sf_dir, "part").select("p_partkey", formats.run_prop(props, "sz").alias("sz"), formats.run_prop(props, "strike").alias("strike"), formats.run_font(props).alias("font"), formats.run_prop(props, "color").alias("colour"))


@query("""
with s as (select p_partkey, p_size * 5 % 256 as a, p_partkey % 256 as r, p_partkey * 7 % 256 as g, p_partkey * 13 % 256 as b from part)
select p_partkey, (r * a + 255 * (255 - a)) // 255 as white_r, (b * a + 255 * (255 - a)) // 255 as white_b, (77 * r + 150 * g + 29 * b) >> 8 as grey, r as high,
  least(greatest(round(r + 1.402 * (b - 128)), 0), 255)::int as red, least(greatest(round(r - 0.344136 * (g - 128) - 0.714136 * (b - 128)), 0), 255)::int as green from s
""")
def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p_partkey")
    r, g, b, a = (c.cast("int") for c in (p % 256, p * 7 % 256, p * 13 % 256, F.col("p_size") * 5 % 256))
    white, rgb = formats.on_white(F.array(r, g, b, a), 3), formats.rgb_of_ycbcr(r, g, b)
    high = formats.high_bytes(F.array(r * 256 + 77))
    found = table(spark, sf_dir, "part").select("p_partkey", white.alias("w"), rgb.alias("c"), formats.grey(r, g, b).alias("grey"), high[0].alias("high"))
    return found.select("p_partkey", F.col("w")[0].alias("white_r"), F.col("w")[2].alias("white_b"), "grey", "high", F.col("c.r").alias("red"), F.col("c.g").alias("green"))


@query("""
with w as (select p_partkey, p_size * 20 as w, (p_partkey % 90 + 1) * 10 as h from part), e as (select *, w * 9525 as ew, h * 9525 as eh from w)
select p_partkey, case when ew > 4000000 then 4000000 else ew end::bigint as cx, case when ew > 4000000 then eh::bigint * 4000000 // ew else eh end::bigint as cy,
  round(w * least(1.0::double, 400.0 / w, 300.0 / h), 6) as fit_w, round(h * least(1.0::double, 400.0 / w, 300.0 / h), 6) as fit_h from e
""")
def picture_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, h = F.col("p_size") * 20, (F.col("p_partkey") % 90 + 1) * 10
    emu, fit = formats.picture_emu(w, h, F.lit(4_000_000)), geometry.picture_fit(w.cast("double"), h.cast("double"), F.lit(400.0), F.lit(300.0))
    found = table(spark, sf_dir, "part").select("p_partkey", emu.alias("e"), fit.alias("f"))
    return found.select("p_partkey", "e.*", F.round("f.width", 6).alias("fit_w"), F.round("f.height", 6).alias("fit_h"))


# Geometry ---------------------------------------------------------------------


@query("""
with b as (select l_orderkey, l_linenumber, l_linenumber % 4 as t, l_quantity / 100 as x0, l_discount as y0, l_quantity / 100 + 0.1 as x1, l_discount + 0.05 as y1 from lineitem)
select l_orderkey, l_linenumber, round(case t when 0 then x0 when 1 then y0 when 2 then 1 - x1 else 1 - y1 end, 9) as fx0, round(case t when 0 then y0 when 1 then 1 - x1 when 2 then 1 - y1 else x0 end, 9) as fy0,
  round(2 * x0 + 3 * y0 + 7, 9) as ux, round(-1 * x0 + 0.5 * y0 - 2, 9) as uy, x0 <= 0.3 and 0.3 <= x1 and y0 <= 0.05 and 0.05 <= y1 as inside from b
""")
def flow_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    x0, y0 = F.col("l_quantity") / 100, F.col("l_discount")
    box = F.struct(x0.alias("x0"), y0.alias("y0"), (x0 + 0.1).alias("x1"), (y0 + 0.05).alias("y1"))
    flow, user = geometry.flow_box(F.col("l_linenumber") % 4, box), geometry.user_point(F.array(*map(F.lit, [2.0, -1.0, 3.0, 0.5, 7.0, -2.0])), x0, y0)
    inside = geometry.in_box(F.lit(0.3), F.lit(0.05), box)
    found = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", flow.alias("f"), user.alias("u"), inside.alias("inside"))
    return found.select("l_orderkey", "l_linenumber", F.round("f.x0", 9).alias("fx0"), F.round("f.y0", 9).alias("fy0"), F.round("u.x", 9).alias("ux"), F.round("u.y", 9).alias("uy"), "inside")


@query("""
select p_partkey, p_size % 3 > 0 and p_retailprice * 2 >= 0.3 * 8000 as scan,
  case when p_size * 20.0 - 48 <= 0 then 1.0 else least(greatest((p_size * 20.0 - 48) / greatest(p_retailprice, 1), 0.1), 8) end::double as zoom,
  case when p_size % 5 = 0 and p_size % 2 = 0 then 20.0 when p_size % 5 = 0 then greatest(p_retailprice / 100, 20.0) else greatest(p_retailprice / 100, 12.0) end::double as row_height,
  case p_size % 3 when 0 then p_size * greatest(1.5, 0.5) when 1 then 14.0 else greatest(14.0, p_size) end::double as line_height,
  10 + 5 + case p_size % 3 when 1 then (greatest(400 - 5 - 3, p_size) - p_size) / 2 when 2 then greatest(400 - 5 - 3, p_size) - p_size else 0 end::double as x from part
""")
def page_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, price = F.col("p_size"), F.col("p_retailprice")
    asked, k = F.when(n % 5 == 0, F.lit(20.0)), n % 3
    rule = F.when(k == 0, "auto").when(k == 1, "exact").otherwise("atLeast")
    align = F.when(k == 1, "center").when(k == 2, "end")
    wide = n.cast("double")
    return table(spark, sf_dir, "part").select(
        "p_partkey", geometry.is_scan(k == 0, price * 2, F.lit(8000.0)).alias("scan"), geometry.fit_zoom(n * 20.0, price).alias("zoom"), geometry.row_height(price / 100, asked, n % 2 == 0).alias("row_height"),
        geometry.line_height(wide, rule, F.when(k == 0, F.lit(1.5)).otherwise(F.lit(14.0))).alias("line_height"), geometry.aligned(align, F.lit(10.0), F.lit(5.0), F.lit(3.0), F.lit(400.0), wide).alias("x"),
    )


@query(f"""
with p as ({_PAGES_SQL}), s as (select l_orderkey, count(*) as n, sum(l_quantity) as w, max(l_extendedprice / 100) as h, arg_max(l_quantity, page) as last from p where page < 2 group by 1)
select l_orderkey, round(least(greatest(least((800 - 48 - 6) / greatest(w + (2 - n) * last, 1), (600 - 48) / greatest(h, 1.0)), 0.1), 8), 9) as zoom from s
""")
def spread_zoom(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = _pages(spark, sf_dir).where("page < 2").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("page", F.col("l_quantity").alias("width"), (F.col("l_extendedprice") / 100).alias("height")))).alias("s"))
    return shown.select("l_orderkey", F.round(geometry.fit_spread(F.lit(800.0), F.lit(600.0), F.col("s"), F.lit(2)), 9).alias("zoom"))


@query(f"""
with p as ({_PAGES_SQL}), h as (select *, case l_linenumber % 3 when 0 then l_quantity * greatest(l_discount * 20, 0.5) when 1 then 14.0 else greatest(14.0, l_quantity) end::double as height from p)
select l_orderkey, page, round(height, 6) as height, round(coalesce(sum(height) over (partition by l_orderkey order by page rows between unbounded preceding and 1 preceding), 0), 6) as top from h
""")
def line_spacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("l_linenumber") % 3
    rows = _pages(spark, sf_dir).withColumns({"rule": F.when(k == 0, "auto").when(k == 1, "exact").otherwise("atLeast"), "value": F.when(k == 0, F.col("l_discount") * 20).otherwise(F.lit(14.0))})
    return ordered.line_tops(rows, ["l_orderkey"], "page", "l_quantity", "rule", "value").select("l_orderkey", "page", F.round("height", 6).alias("height"), F.round("top", 6).alias("top"))


_BOX = "page * 10.0 as x0, l_discount * 1000 as y0, page * 10.0 + l_quantity as x1, l_discount * 1000 + 10 as y1"


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    x0, y0 = F.col("page") * 10.0, F.col("l_discount") * 1000
    box = F.struct("page", x0.alias("x0"), y0.alias("y0"), (x0 + F.col("l_quantity")).alias("x1"), (y0 + 10).alias("y1"))
    return _pages(spark, sf_dir).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(box)).alias("boxes"))


@query(f"""
with p as ({_PAGES_SQL}), b as (select l_orderkey, page, {_BOX} from p)
select l_orderkey, arg_min(page, (greatest(y0 - 45, 45 - y1, 0), greatest(x0 - 25, 25 - x1, 0), page))::int as line, coalesce(min(page) filter (25 < (x0 + x1) / 2), count(*))::int as caret,
  bool_or(25 between x0 and x1 and 45 between y0 and y1) as over_text from b group by l_orderkey
""")
def points_in_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = F.lit(25.0), F.lit(45.0)
    return _boxes(spark, sf_dir).select("l_orderkey", lines.nearest_line(F.col("boxes"), x, y).alias("line"), lines.caret_at(F.col("boxes"), x).alias("caret"), editing.over_text(F.col("boxes"), x, y).alias("over_text"))


def _glyphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names as characters of one height, six wide, on two lines that end at the first blank and at the end."""
    letters = F.split("p_name", "")
    n = F.size(letters)
    cut = F.instr("p_name", " ")
    box = lambda c, i: F.struct(c.alias("text"), (i * 6.0).alias("x0"), F.lit(0.0).alias("y0"), (i * 6.0 + 6).alias("x1"), F.lit(10.0).alias("y1"))
    line = lambda a, z: F.struct(a.alias("first"), z.alias("end"))
    return table(spark, sf_dir, "part").select("p_partkey", "p_name", n.alias("n"), F.transform(letters, box).alias("chars"), F.array(line(F.lit(0), cut), line(cut, n)).alias("lines"), (F.col("p_partkey") % n).cast("int").alias("caret"))


_GLYPHS = r"""
with g as (select p_partkey, p_name as t, length(p_name) as n, instr(p_name, ' ') as cut, (p_partkey % length(p_name))::int as c from part
), l as (select *, case when c < cut then 0 else cut end as a, case when c < cut then cut else n end as z from g)
"""


@query(_GLYPHS + r"""
, w as (select *, list_max(list_filter(range(a, c + 1), lambda i: i = a or not regexp_matches(t[i + 1], '[\p{L}\p{N}]') or not regexp_matches(t[i], '[\p{L}\p{N}]'))) as s, list_min(list_filter(range(c + 1, z), lambda i: not regexp_matches(t[i + 1], '[\p{L}\p{N}]') or not regexp_matches(t[i], '[\p{L}\p{N}]'))) as e from l)
select p_partkey, case when regexp_matches(t[c + 1], '[\p{L}\p{N}]') then s else c end::int as word_from, case when regexp_matches(t[c + 1], '[\p{L}\p{N}]') then coalesce(e, z) else c + 1 end::int as word_to, a::int as line_from, z::int as line_to from w
""")
def words_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _glyphs(spark, sf_dir)
    found = g.select("p_partkey", lines.word_at(F.col("chars"), F.col("lines"), F.col("caret")).alias("w"), lines.line_around(F.col("lines"), F.col("caret")).alias("l"))
    return found.select("p_partkey", F.col("w.from").alias("word_from"), F.col("w.to").alias("word_to"), F.col("l.from").alias("line_from"), F.col("l.to").alias("line_to"))


@query(_GLYPHS + r"""
, p as (select p_partkey, t, a1, z1 from (select p_partkey, t, greatest(0, 2) as a1, least(cut, n - 1) as z1 from g union all select p_partkey, t, greatest(cut, 2), least(n, n - 1) from g) where a1 < z1
), s as (select p_partkey, list_filter(range(a1, z1), lambda i: trim(t[i + 1]) <> '') as solid from p)
select p_partkey, list_min(solid)::int as "from", (list_max(solid) + 1)::int as "to" from s where len(solid) > 0
""")
def line_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _glyphs(spark, sf_dir).select("p_partkey", F.explode(lines.pieces(F.col("chars"), F.col("lines"), F.lit(2), F.col("n") - 1)).alias("x"))
    return found.select("p_partkey", "x.*")


@query("with t as (select p_partkey, string_split(p_name, '') as l from part) select p_partkey, (list_sum(list_transform(l, lambda c: case c when 'i' then 222 when ' ' then 278 when 'm' then 833 else 556 end)) * 12 / 1000)::double as width from t")
def text_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", lines.text_width(F.col("p_name"), {"i": 222, " ": 278, "m": 833}, 12.0).alias("width"))


@query(f"""
with p as ({_PAGES_SQL}), t as (select *, 24.0::double + coalesce(sum(round(l_quantity * 1.5) + 18) over (partition by l_orderkey order by page rows between unbounded preceding and 1 preceding), 0) as top from p
), y as (select l_orderkey, page as look, l_extendedprice / 500 as y from p
), f as (select y.l_orderkey, look, y.y, coalesce(arg_max(t.page, t.page) filter (t.top <= y.y), 0)::int as page from y join t using (l_orderkey) group by y.l_orderkey, look, y.y)
select f.l_orderkey, look, f.page, round(greatest((y - top) / (l_quantity * 1.5), 0), 9) as fraction from f join t on t.l_orderkey = f.l_orderkey and t.page = f.page
""")
def reading_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _pages(spark, sf_dir)
    tops = ordered.page_offsets(pages, ["l_orderkey"], "page", "l_quantity", 1.5).select("l_orderkey", "page", "top", "l_quantity")
    looked = pages.select("l_orderkey", F.col("page").alias("look"), (F.col("l_extendedprice") / 500).alias("y"))
    at = ordered.page_at(tops, looked, ["l_orderkey"], "page", "y")
    return at.join(tops, ["l_orderkey", "page"]).select("l_orderkey", "look", "page", F.round(editing.reading_fraction(F.col("y"), F.col("top"), F.col("l_quantity") * 1.5), 9).alias("fraction"))


# Predicates ---------------------------------------------------------------------


@query("""
with f as (select o_orderkey, o_orderstatus = 'F' as first, o_custkey % 2 = 0 as header, o_custkey % 3 = 0 as footer, o_orderpriority as own from orders)
select o_orderkey, case when first and header and footer then 'first' else own end as header, o_orderstatus = 'P' or o_custkey % 5 = 0 or o_orderpriority in ('1-URGENT', '2-HIGH') as floats,
  (o_custkey % 2 = 0) or (o_custkey % 3 = 0) as has_borders from f join orders using (o_orderkey)
""")
def page_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("o_custkey")
    first = F.lit("first")
    header = editing.page_header(F.col("o_orderstatus") == "F", F.col("o_orderpriority"), F.when(c % 2 == 0, first), F.when(c % 3 == 0, F.lit("f")))
    frame = F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "margin").otherwise("paragraph")
    edges = F.create_map(F.lit("top"), F.when(c % 2 == 0, 1), F.lit("left"), F.when(c % 3 == 0, 1))
    return table(spark, sf_dir, "orders").select("o_orderkey", header.alias("header"), editing.floats(F.col("o_orderstatus") == "P", c % 5 != 0, frame).alias("floats"), editing.has_borders(edges).alias("has_borders"))


@query("select user_id, bool_and(event_type in ('click', 'view')) as covered from events group by user_id")
def all_covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_list(F.when(F.col("event_type").isin("click", "view"), F.lit(True))).alias("some"), F.collect_list(F.col("event_type").isin("click", "view")).alias("flags"))
    return flags.select("user_id", editing.all_covered(F.col("flags")).alias("covered"))


@query("select conv_id, turn, role in ('user', 'assistant') as kept from conversations where role in ('user', 'assistant') or turn % 2 = 0")
def visible_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("role") == "user", "paragraph").when(F.col("role") == "assistant", "table").otherwise("other")
    items = table(spark, sf_dir, "conversations").withColumns({"kind": kind, "n_blocks": F.when(F.col("turn") % 2 == 0, 1).otherwise(0)})
    return editing.visible_items(items).select("conv_id", "turn", (F.col("kind") != "other").alias("kept"))


@query("select conv_id, turn, case when turn % 3 = 0 then upper(replace(text, 'ß', 'SS')) when turn % 5 = 1 then turn::varchar else text end as text from conversations where role <> 'system'")
def shown_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn = F.col("turn")
    runs = table(spark, sf_dir, "conversations").withColumns({"hidden": F.col("role") == "system", "caps": turn % 3 == 0, "field_value": F.when((turn % 5 == 1) & (turn % 3 != 0), turn.cast("string")), "math": F.lit(None).cast("string")})
    return texts.shown_runs(runs).select("conv_id", "turn", "text")


@query("""
with s as (select conv_id, turn, length(text) as n from conversations), a as (select conv_id, turn, 0 as a, n // 3 as b, n // 2 as c, n as d from s)
select conv_id, turn, a as start, b as "end" from a where b > a union all select conv_id, turn, c, d from a where d > c
""")
def editable_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("text")
    turns = table(spark, sf_dir, "conversations").where("text is not null")
    whole = turns.select("conv_id", "turn", F.lit(0).alias("start"), n.alias("end"))
    locked = turns.select("conv_id", "turn", F.floor(n / 3).cast("int").alias("start"), F.floor(n / 2).cast("int").alias("end")).where(F.col("start") < F.col("end"))
    return lookup.subtract_spans(whole, locked, ["conv_id", "turn"]).select("conv_id", "turn", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


# Lookups --------------------------------------------------------------------------


@query("""
with o as (select n_name || '.xml' as name, 'nation-' || n_nationkey as type from nation where n_nationkey % 3 = 0)
select page_id, coalesce(o.type, case lower(e) when 'xml' then 'application/xml' when 'pdf' then 'document' end) as type
from (select page_id, case when page_id % 4 = 0 then n_name || '.xml' when page_id % 4 = 1 then 'x' || page_id || '.PDF' else 'word/none' end as name, case when page_id % 4 = 0 then 'xml' when page_id % 4 = 1 then 'PDF' end as e from pages join nation on n_nationkey = page_id % 25) left join o using (name)
""")
def part_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    k = F.col("page_id") % 4
    name = F.when(k == 0, F.concat("n_name", F.lit(".xml"))).when(k == 1, F.concat(F.lit("x"), F.col("page_id").cast("string"), F.lit(".PDF"))).otherwise("word/none")
    parts = table(spark, sf_dir, "pages").join(nation, F.col("n_nationkey") == F.col("page_id") % 25).select("page_id", name.alias("name"))
    by_name = nation.where("n_nationkey % 3 = 0").select(F.concat("n_name", F.lit(".xml")).alias("name"), F.concat(F.lit("nation-"), F.col("n_nationkey").cast("string")).alias("type"))
    return lookup.content_type(parts, by_name, values(spark, "('XML', 'application/xml'), ('pdf', 'document')", "ext, type")).select("page_id", "type")


@query("""
with recursive n as (select c_custkey % 7 as doc, c_custkey // 7 as node, c_custkey // 21 as up, case when c_custkey % 5 = 0 then c_name end as value from customer where c_custkey > 6
), w as (select doc, node, up, value, 0 as hops from n union all select w.doc, w.node, n.up, n.value, hops + 1 from w join n on n.doc = w.doc and n.node = w.up where w.value is null and hops < 63)
select n.doc, n.node, max(w.value) as value from n left join w on w.doc = n.doc and w.node = n.node and w.value is not null group by n.doc, n.node
""")
def inherited_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as nodes of seven page trees: the name of the nearest one above whose number is a multiple of five."""
    k = F.col("c_custkey")
    nodes = table(spark, sf_dir, "customer").where("c_custkey > 6").select((k % 7).alias("doc"), F.floor(k / 7).alias("node"), F.floor(k / 21).alias("parent"), F.when(k % 5 == 0, F.col("c_name")).alias("value"))
    return lookup.inherited_attribute(nodes, ["doc"], "value").select("doc", "node", "value")


@query("""
with recursive n as (select p_partkey % 5 as doc, p_partkey // 5 as node, case when p_partkey % 4 > 0 then p_partkey // 5 - 1 - p_partkey // 5 % 3 end as up, case when p_partkey % 4 = 0 then p_size end as page from part
), w as (select doc, node, up, page, 0 as hops from n union all select w.doc, w.node, n.up, n.page, hops + 1 from w join n on n.doc = w.doc and n.node = w.up where w.page is null and hops < 8)
select n.doc, n.node, max(w.page) as page from n left join w on w.doc = n.doc and w.node = n.node and w.page is not null group by n.doc, n.node
""")
def named_destinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as objects of five documents that lead to a page or to another object, eight steps at most."""
    k = F.col("p_partkey")
    node = F.floor(k / 5)
    objects = table(spark, sf_dir, "part").select((k % 5).alias("doc"), node.alias("node"), F.when(k % 4 > 0, node - 1 - node % 3).alias("target"), F.when(k % 4 == 0, F.col("p_size")).alias("page"))
    return lookup.destinations(objects, ["doc"]).select("doc", "node", "page")


@query("select page_id, k as rel_id from pages, (select unnest(range(0, 40)) k) where contains(html, '\"' || k || '\"')")
def referenced_rels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers that stand quoted in a page's markup."""
    pages = table(spark, sf_dir, "pages")
    rels = pages.select("page_id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(39)), lambda k: k.cast("string"))).alias("rel_id"))
    return lookup.referenced(rels, pages.select("page_id", F.col("html").alias("xml")), ["page_id"]).select("page_id", F.col("rel_id").cast("long").alias("rel_id"))


@query("select min(p_partkey) as num from part where p_size % 9 = 0 and p_partkey > 5")
def bullet_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels = table(spark, sf_dir, "part").where("p_partkey > 5").select(F.col("p_partkey").alias("num"), (F.col("p_size") % 3).alias("level"), F.when(F.col("p_size") % 9 == 0, "bullet").otherwise("decimal").alias("format"))
    return lookup.default_bullet_list(levels)


@query("""
with old as (select conv_id, turn, role, text from conversations), f as (select conv_id, role, arg_min(text, turn) as t from old group by 1, 2), a as (select conv_id, arg_min(text, turn) as t from old group by 1)
select o.conv_id, o.turn, md5(coalesce(case when o.turn % 2 = 0 then f.t end, a.t)) as props from old o left join f on f.conv_id = o.conv_id and f.role = o.role left join a on a.conv_id = o.conv_id
""")
def inherited_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edited runs take the properties of the first run of their flags; those with flags of their own those of the first run."""
    flags = lambda odd: {"bold": F.col("role") == "user", "italic": F.col("role") == "system", "underline": odd, "highlight": F.lit(False)}
    turns = table(spark, sf_dir, "conversations")
    old = turns.withColumns(flags(F.lit(False))).select("conv_id", "turn", "bold", "italic", "underline", "highlight", F.md5("text").alias("props"))
    new = turns.withColumns(flags(F.col("turn") % 2 == 1)).select("conv_id", "turn", "bold", "italic", "underline", "highlight", F.lit("none").alias("props"))
    return editing.inherit_props(new, old, ["conv_id"], "turn").select("conv_id", "turn", "props")


# Aggregations ------------------------------------------------------------------------


@query(f"""
with p as ({_PAGES_SQL}), r as (select l_orderkey, l_linenumber as row, sum(greatest(l_quantity::int % 4, 1)) as n, max(page % 3 * 4) as w from p group by 1, 2)
select l_orderkey, greatest(max(n), max(w))::int as n_columns from r group by 1
""")
def column_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _pages(spark, sf_dir).select("l_orderkey", F.col("l_linenumber").alias("row"), (F.col("l_quantity").cast("int") % 4).alias("span"), "page")
    return editing.column_count(cells, ["l_orderkey"], F.col("page") % 3 * 4)


@query("select user_id, bool_or(event_type = 'purchase') as counts_pages from events group by user_id")
def page_count_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    field = F.when(F.col("event_type") == "purchase", "pages").when(F.col("event_type") == "view", "page")
    return editing.counts_pages(table(spark, sf_dir, "events"), ["user_id"], field)


@query(f"with p as ({_PAGES_SQL}) select l_orderkey, string_agg(l_partkey::varchar, ',' order by page) as ids from p group by 1")
def annotation_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = editing.annotation_ids(_pages(spark, sf_dir), ["l_orderkey"], "page", "l_partkey")
    return found.select("l_orderkey", F.array_join("ids", ",").alias("ids"))


@query("select conv_id, turn from conversations where turn not in (1, 4) and not (turn in (2, 5))")
def removed_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotations but those of turns 1 and 4 and the pop-ups that belong to them."""
    key = lambda t: F.concat_ws(":", "conv_id", t)
    turns = table(spark, sf_dir, "conversations")
    annots = turns.select("conv_id", "turn", key("turn").alias("annot_id"), F.when(F.col("turn").isin(2, 5), key(F.col("turn") - 1)).alias("parent_id"))
    return sets.remove_annotations(annots, annots.where("turn in (1, 4)")).select("conv_id", "turn")


@query("select case when bool_or(event_type = 'purchase') then 'pdf' else 'docx' end as format from events")
def combined_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.combined_format(table(spark, sf_dir, "events").select(F.when(F.col("event_type") == "purchase", "pdf").otherwise("text").alias("f")), "f")


# Ordered ------------------------------------------------------------------------------


@query("""
with e as (select event_id, event_type in ('click', 'view') as foot, event_type = 'view' and event_id % 3 = 0 as custom, user_id, ts from events
), n as (select *, row_number() over (partition by user_id, foot, custom order by ts, event_id) as n from e)
select event_id, case when custom then '' when foot then n::varchar else lower(repeat('M', (n // 1000)::int) || (['', 'C', 'CC', 'CCC', 'CD', 'D', 'DC', 'DCC', 'DCCC', 'CM'])[n // 100 % 10 + 1]
  || (['', 'X', 'XX', 'XXX', 'XL', 'L', 'LX', 'LXX', 'LXXX', 'XC'])[n // 10 % 10 + 1] || (['', 'I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX'])[n % 10 + 1]) end as mark from n
""")
def note_numbers_custom(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = table(spark, sf_dir, "events").withColumn("at", F.struct("ts", "event_id"))
    custom = (F.col("event_type") == "view") & (F.col("event_id") % 3 == 0)
    return ordered.note_numbers(refs, ["user_id"], "at", F.col("event_type").isin("click", "view"), custom).select("event_id", "mark")


_DEEP = "select conv_id, turn, case role when 'system' then 1 when 'user' then turn + 1 else 1 + turn // 2 end::int as level, case when role = 'assistant' and turn % 3 = 1 then conv_id + turn end as page from conversations"


@query(f"""
with o as ({_DEEP}), n as (select a.conv_id, a.turn, a.level, a.page, (select min(b.turn) from o b where b.conv_id = a.conv_id and b.turn > a.turn and b.level <= a.level) as stop from o a)
select n.conv_id, n.turn, n.level, coalesce(n.page, p.page) as page from n left join lateral (select o.page from o where o.conv_id = n.conv_id and o.turn > n.turn and (n.stop is null or o.turn < n.stop) and o.page is not null order by o.turn limit 1) p on true
where coalesce(n.page, p.page) is not null
""")
def outline_first_child(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as headings, users' at the level of their turn: page-less ones take the first page below them, however deep."""
    turn = F.col("turn")
    level = F.when(F.col("role") == "system", 1).when(F.col("role") == "user", turn + 1).otherwise(1 + F.floor(turn / 2)).cast("int")
    page = F.when((F.col("role") == "assistant") & (turn % 3 == 1), F.col("conv_id") + turn)
    outline = table(spark, sf_dir, "conversations").select("conv_id", "turn", level.alias("level"), page.alias("page"))
    return ordered.outline_pages(outline, ["conv_id"], "turn", "level", "page")


@query(f"""
with p as ({_PAGES_SQL}) select l_orderkey, string_agg(page::varchar, ' ' order by page) as text, 1 as n_lines from p group by l_orderkey
""")
def line_of_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items side by side on one line, with a gap between any two: the text has a space in each gap."""
    glyph = F.struct("page", F.col("page").cast("string").alias("text"), (F.col("page") * 20.0).alias("x0"), F.lit(0.0).alias("y0"), (F.col("page") * 20.0 + 6).alias("x1"), F.lit(12.0).alias("y1"))
    chars = _pages(spark, sf_dir).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(glyph)).alias("chars"))
    lined = chars.withColumn("lines", lines.lines(F.col("chars")))
    return lined.select("l_orderkey", lines.text(F.col("chars"), F.col("lines")).alias("text"), F.size("lines").alias("n_lines"))


@query(f"""
with p as ({_PAGES_SQL}), n as (select l_orderkey, page, page // 3 as line, row_number() over (partition by l_orderkey, page // 3 order by page) as k from p
), t as (select l_orderkey, line, string_agg(chr((97 + page % 26)::int), '' order by page) as t from n group by 1, 2)
select l_orderkey, string_agg(t, chr(10) order by line) as text, count(*)::int as n_lines from t group by 1
""")
def line_builder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as letters, three to a line, each line below the one before and back at its start."""
    at, k = F.floor(F.col("page") / 3), F.col("page") % 3
    glyph = F.struct("page", F.char((F.col("page") % 26 + 97).cast("long")).alias("text"), (k * 6.0).alias("x0"), (at * 15.0).alias("y0"), (k * 6.0 + 6).alias("x1"), (at * 15.0 + 12).alias("y1"))
    chars = _pages(spark, sf_dir).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(glyph)).alias("chars"))
    lined = chars.withColumn("lines", lines.lines(F.col("chars")))
    return lined.select("l_orderkey", lines.text(F.col("chars"), F.col("lines")).alias("text"), F.size("lines").alias("n_lines"))


@query("""
with c as (select user_id, event_type, row_number() over (partition by user_id order by ts, event_id) as pos, event_type = 'signup' as skip from events
), k as (select *, coalesce(event_type is distinct from lag(event_type) over w, true) as new from c where not skip window w as (partition by user_id order by pos)
), r as (select *, sum(new::int) over (partition by user_id order by pos) as run from k)
select user_id, run::bigint as run, any_value(event_type) = 'click' as bold, any_value(event_type) = 'view' as italic, string_agg(left(event_type, 1), '' order by pos) as text from r group by user_id, run
""")
def line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events as characters of an editor's line; sign-ups are placeholders."""
    t = F.col("event_type")
    pos = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    chars = table(spark, sf_dir, "events").select("user_id", pos.alias("pos"), F.substring(t, 1, 1).alias("c"), (t == "click").alias("bold"), (t == "view").alias("italic"), (t == "purchase").alias("underline"), (~t.isin("click", "view", "purchase", "signup")).alias("highlight"), (t == "signup").alias("skip"))
    return editing.line_runs(chars, ["user_id"], "pos", "c", F.col("skip")).select("user_id", "run", "bold", "italic", "text")


@query("""
select p_partkey, c as col, r as row from (select p_partkey, p_size, ceil(floor(612.0 * p_size) / 1024)::int as cols, ceil(floor(792.0 * p_size) / 1024)::int as rows, floor(612.0 * p_size)::bigint as w, floor(792.0 * p_size)::bigint as h from part) g,
  lateral (select unnest(range(least(floor(floor(0.2 * w) / 1024), cols - 1)::int, least(floor(floor(0.4 * w) / 1024), cols - 1)::int + 1))::int c), lateral (select unnest(range(0, least(floor(floor(0.1 * h) / 1024), rows - 1)::int + 1))::int r)
where (w::double * h > 24000000 or w > 16384 or h > 16384) and p_partkey % 2 = 0
""")
def tiles_wanted(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = geometry.grid(F.lit(612.0), F.lit(792.0), F.col("p_size").cast("double"))
    wanted = lines.tiles_wanted(F.col("g"), F.col("p_partkey") % 2 == 0, F.lit(0.2), F.lit(0.4), F.lit(0.0), F.lit(0.1))
    return table(spark, sf_dir, "part").withColumn("g", g).select("p_partkey", F.explode(wanted).alias("t")).select("p_partkey", "t.*")


@query("""
with m as (select conv_id, turn, row_number() over (partition by conv_id order by turn) r, count(*) over (partition by conv_id) n, first_value(turn) over (partition by conv_id order by turn) f, lead(turn) over (partition by conv_id order by turn) l from conversations where role = 'user')
select c.conv_id, c.turn, case when k.n is null then 'nothing' when k.n = 1 and m.turn is not null then 'only' else 'match' end as outcome, case when m.turn is not null and k.n > 1 then coalesce(l, f) end as next_page
from conversations c left join (select conv_id, max(n) n from m group by 1) k on k.conv_id = c.conv_id left join m on m.conv_id = c.conv_id and m.turn = c.turn
""")
def next_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the search goes on from each turn: no match at all, the only match again, or the next one."""
    turns = table(spark, sf_dir, "conversations")
    matches = turns.where("role = 'user'").select("conv_id", "turn", F.lit(0).alias("idx"))
    found = search.next_outcome(turns.select("conv_id", "turn"), matches, ["conv_id"], "turn", "idx")
    return found.select("conv_id", "turn", "outcome", F.when(F.col("here") & (F.col("outcome") == "match"), F.col("next_page")).alias("next_page"))


# Looks -----------------------------------------------------------------------------------

_SHEET = """('Normal', 'paragraph', null, 'Tahoma', null, null), ('Lead', 'paragraph', 'Normal', null, 14, true),
 ('Strong', 'character', null, null, null, true), ('Code', 'character', 'Strong', 'Mono', 9, null), ('Odd', 'character', 'Lead', null, null, null)"""


@query(f"""
with recursive s(id, kind, based, font, size, bold) as (values {_SHEET}
), c(id, anc, depth) as (select id, id, 0 from s union all select c.id, n.id, depth + 1 from c join s a on a.id = c.anc join s n on n.id = a.based where depth < 16
), p as (select c.id, arg_min(font, depth) filter (font is not null) font, arg_min(size, depth) filter (size is not null) size, arg_min(bold, depth) filter (bold is not null) bold from c join s on s.id = c.anc group by c.id
), ch as (select c.id, arg_min(font, depth) filter (font is not null) font, arg_min(size, depth) filter (size is not null) size, arg_min(bold, depth) filter (bold is not null) bold from c join s on s.id = c.anc where s.kind = 'character' group by c.id
), r as (select p_partkey, case p_size % 3 when 0 then 'Normal' when 1 then 'Lead' end as ps, case p_partkey % 4 when 0 then 'Strong' when 1 then 'Code' when 2 then 'Odd' end as rs, case when p_size % 5 = 0 then p_size::double end as size from part)
select p_partkey, coalesce(ch.font, p.font, 'Calibri') as font, coalesce(r.size, ch.size, p.size, 10)::double as size, coalesce(ch.bold, p.bold, false) as bold from r left join p on p.id = ps left join ch on ch.id = rs
""")
def run_looks(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, k = F.col("p_size"), F.col("p_partkey") % 4
    styles = values(spark, _SHEET, "style_id, kind, based_on, font, size, bold").select(F.lit(1).alias("doc"), "*")
    runs = table(spark, sf_dir, "part").select(F.lit(1).alias("doc"), "p_partkey", F.when(n % 3 == 0, "Normal").when(n % 3 == 1, "Lead").alias("style_id"), F.when(k == 0, "Strong").when(k == 1, "Code").when(k == 2, "Odd").alias("run_style"), F.when(n % 5 == 0, n.cast("double")).alias("size"))
    return looks.run_looks(runs, styles, ["doc"]).select("p_partkey", "font", F.col("size").cast("double").alias("size"), "bold")


_TABLE_STYLES = "('Grid', null), ('Light', 'Grid'), ('Bare', 'Light')"
_TABLE_EDGES = "('Grid', 'top', 0, 1.0d), ('Grid', 'left', 0, 1.0d), ('Light', 'top', 255, 0.5d), ('Bare', 'left', null, null)"


@query(f"""
with recursive s(id, based) as (values {_TABLE_STYLES}), e(id, edge, colour, width) as (values {_TABLE_EDGES.replace("1.0d", "1.0").replace("0.5d", "0.5")}
), c(id, anc, depth) as (select id, id, 0 from s union all select c.id, a.based, depth + 1 from c join s a on a.id = c.anc where a.based is not null
), t as (select p_partkey, case p_size % 4 when 0 then 'Grid' when 1 then 'Light' when 2 then 'Bare' end as id, p_size % 5 as k from part
), a as (select p_partkey, edge, depth, colour, width::double as width from t join c on c.id = t.id join e on e.id = c.anc union all select p_partkey, 'top', -1, 7, 2.0 from t where k = 0 union all select p_partkey, 'left', -1, null, null from t where k = 1
), n as (select p_partkey, edge, arg_min({{'c': colour, 'w': width}}, depth) as line from a group by 1, 2)
select p_partkey, edge, line.c::int as colour, line.w::double as width from n where line.w is not null
""")
def table_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = F.lit(1).alias("doc")
    styles = values(spark, _TABLE_STYLES, "style_id, based_on").select(one, "*")
    edges = values(spark, _TABLE_EDGES, "style_id, edge, colour, width").select(one, "*")
    k = F.col("p_size") % 4
    tables = table(spark, sf_dir, "part").select(one, F.col("p_partkey").alias("table"), F.when(k == 0, "Grid").when(k == 1, "Light").when(k == 2, "Bare").alias("style_id"), (F.col("p_size") % 5).alias("k"))
    own = tables.where("k < 2").select("doc", "table", F.when(F.col("k") == 0, "top").otherwise("left").alias("edge"), F.when(F.col("k") == 0, 7).alias("colour"), F.when(F.col("k") == 0, F.lit(2.0)).alias("width"))
    return looks.table_edges(tables, edges, own, styles, ["doc"]).select(F.col("table").alias("p_partkey"), "edge", F.col("colour").cast("int").alias("colour"), "width")


@query(f"""
with recursive s(id, based) as (values {_TABLE_STYLES}), c(id, anc, depth) as (select id, id, 0 from s union all select c.id, a.based, depth + 1 from c join s a on a.id = c.anc where a.based is not null
), m(id, t, l) as (values ('Grid', 1.0, null), ('Light', null, 3.0)), f as (select c.id, arg_min(t, depth) filter (t is not null) as t, arg_min(l, depth) filter (l is not null) as l from c join m on m.id = c.anc group by 1)
select p_partkey, coalesce(case when p_size % 5 = 0 then 9.0 end, f.t, 0)::double as top, 5.4::double as "right", coalesce(f.l, 5.4)::double as "left",
  case when p_size % 2 = 0 then 'own' when p_size % 3 = 0 then 'top' else 'insideH' end as line from part left join f on f.id = case p_size % 4 when 0 then 'Grid' when 1 then 'Light' when 2 then 'Bare' end
""")
def table_padding(spark: SparkSession, sf_dir: str) -> DataFrame:
    one, none = F.lit(1).alias("doc"), F.lit(None).cast("double")
    styles = values(spark, _TABLE_STYLES, "style_id, based_on").select(one, "*")
    margins = values(spark, "('Grid', 1.0d, null, null, null), ('Light', null, null, null, 3.0d)", "style_id, top, right, bottom, left").select(one, "style_id", *[F.col(c).cast("double").alias(c) for c in ("top", "right", "bottom", "left")])
    n = F.col("p_size")
    k = n % 4
    tables = table(spark, sf_dir, "part").select(one, "p_partkey", n.alias("n"), F.when(k == 0, "Grid").when(k == 1, "Light").when(k == 2, "Bare").alias("style_id"), F.when(n % 5 == 0, F.lit(9.0)).alias("top"), *[none.alias(c) for c in ("right", "bottom", "left")])
    padded = looks.table_padding(tables, margins, styles, ["doc"])
    own = F.when(F.col("n") % 2 == 0, F.create_map(F.lit("top"), F.lit("own"))).otherwise(F.create_map(F.lit("x"), F.lit("y")))
    edge = looks.cell_edge(own, F.create_map(F.lit("top"), F.lit("top"), F.lit("insideH"), F.lit("insideH")), F.lit("top"), F.col("n") % 3, F.lit(0), F.lit(1), F.lit(3), F.lit(1))
    return padded.select("p_partkey", "top", "right", "left", edge.alias("line"))


@query("""
with k as (select conv_id, turn, case turn % 5 when 0 then 'title' when 1 then 'heading' when 2 then 'list' when 3 then 'quote' else 'normal' end as kind, (turn % 4 + 1)::int as level from conversations)
select conv_id, turn, case kind when 'title' then 28.0 when 'heading' then case level when 1 then 16.0 when 2 then 13.0 else 12.0 end else 11.0 end::double as size, kind = 'heading' as bold, kind = 'quote' as italic,
  case kind when 'title' then 8.0 when 'heading' then 6.0 when 'list' then 0.0 else 6.0 end::double as after, case kind when 'list' then 18.0 * (level + 1) when 'quote' then 36.0 else 0 end::double as "left", case when kind = 'list' then (['•', '◦', '▪'])[level % 3 + 1] end as label from k
""")
def fallback_looks(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn = F.col("turn")
    kind = F.element_at(F.array(*map(F.lit, ["title", "heading", "list", "quote", "normal"])), (turn % 5 + 1).cast("int"))
    paragraphs = table(spark, sf_dir, "conversations").select("conv_id", "turn", kind.alias("kind"), (turn % 4 + 1).cast("int").alias("level"))
    return looks.fallback(paragraphs, "kind", "level", F.lit("Calibri"), F.lit(11.0), F.lit(6.0)).select("conv_id", "turn", "size", "bold", "italic", "after", "left", "label")


@query("""
with p as (select conv_id, turn, case turn % 3 when 0 then 'heading' when 1 then 'list' else 'normal' end as kind, (turn % 2 + 1)::int as level, case when role = 'user' then 'Body' when role = 'system' then 'Heading1' end as style, case when turn % 4 < 2 then 'x' end as label from conversations
), l as (select *, coalesce(case style when 'Body' then 12.0 when 'Heading1' then 20.0 end, 10.0) as size0 from p)
select conv_id, turn, case when kind = 'normal' and label is not null then 'list' when kind = 'list' and label is null then 'normal' else kind end as kind,
  case when kind = 'heading' and style is null then case level when 1 then 16.0 when 2 then 13.0 else 12.0 end else size0 end::double as size, case when kind = 'heading' and style is null then true else coalesce(style = 'Heading1', false) end as bold from l
""")
def restyled(spark: SparkSession, sf_dir: str) -> DataFrame:
    one, turn = F.lit(1).alias("doc"), F.col("turn")
    defaults = {"size": 10.0, "bold": False, "italic": False, "colour": 0, "before": 0.0, "after": 0.0, "left": 0.0}
    styles = values(spark, "('Body', null, 12.0d, null), ('Heading1', null, 20.0d, true)", "style_id, based_on, size, bold").select(one, F.col("style_id"), F.col("based_on").cast("string").alias("based_on"), "size", "bold", *[F.lit(None).cast(t).alias(c) for c, t in (("italic", "boolean"), ("colour", "int"), ("before", "double"), ("after", "double"), ("left", "double"))])
    kind = F.element_at(F.array(*map(F.lit, ["heading", "list", "normal"])), (turn % 3 + 1).cast("int"))
    own = {c: F.lit(None).cast(t) for c, t in (("size", "double"), ("bold", "boolean"), ("italic", "boolean"), ("colour", "int"), ("before", "double"), ("after", "double"), ("left", "double"))}
    paragraphs = table(spark, sf_dir, "conversations").select(one, "conv_id", "turn", kind.alias("kind"), (turn % 2 + 1).cast("int").alias("level"), F.when(F.col("role") == "user", "Body").when(F.col("role") == "system", "Heading1").alias("style_id"), F.when(turn % 4 < 2, "x").alias("label"), F.lit(0).alias("direct_level"), *[c.alias(n) for n, c in own.items()])
    return looks.restyle(paragraphs, styles, ["doc"], list(defaults), defaults).select("conv_id", "turn", "kind", "size", "bold")


@query("""
with o as (select conv_id, turn, case when role = 'user' then 'heading' else 'list' end as kind from conversations), e as (select conv_id, turn, turn - turn % 2 as base, case when turn % 3 = 0 then 'heading' when turn % 3 = 1 then 'list' else 'title' end as kind from conversations)
select e.conv_id, e.turn as seq, e.kind, case when o.kind = e.kind then 'Base' || o.turn when e.kind = 'heading' then 'Heading1' end as style_id, case when o.kind = e.kind then o.turn::int when e.kind = 'list' then 3 end as num from e left join o on o.conv_id = e.conv_id and o.turn = e.base
""")
def relooked(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn = F.col("turn")
    turns = table(spark, sf_dir, "conversations")
    originals = turns.select("conv_id", turn.alias("pos"), F.when(F.col("role") == "user", "heading").otherwise("list").alias("kind"), F.lit(1).alias("level"), F.concat(F.lit("Base"), turn.cast("string")).alias("style_id"), turn.cast("int").alias("num"))
    edited = turns.select("conv_id", turn.alias("seq"), (turn - turn % 2).alias("base"), F.when(turn % 3 == 0, "heading").when(turn % 3 == 1, "list").otherwise("title").alias("kind"), F.lit(1).alias("level"))
    styles = turns.select("conv_id").distinct().withColumn("style_id", F.lit("Heading1"))
    return looks.relooked(edited, originals, styles, F.lit(3), ["conv_id"]).select("conv_id", "seq", "kind", "style_id", "num")


@query(f"with p as ({_PAGES_SQL}) select l_orderkey, (row_number() over (partition by l_orderkey order by page // 2, case when page % 2 = 0 then 0 else 1 end, page) - 1)::int as pos, l_partkey from p where l_returnflag <> 'R'")
def flattened_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as paragraphs in cells: in reading order of their places in nested tables."""
    blocks = _pages(spark, sf_dir).withColumn("path", F.array(F.floor(F.col("page") / 2), F.col("page") % 2)).withColumn("kind", F.when(F.col("l_returnflag") == "R", "table").otherwise("paragraph"))
    return looks.flatten(blocks, ["l_orderkey"], "path").select("l_orderkey", "pos", "l_partkey")


# Logs -------------------------------------------------------------------------------------


@query("""
with n as (select *, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) as k from events), w as (select user_id, max(ts) as whole from events where event_type = 'purchase' group by 1)
select n.user_id, n.event_type, n.event_id from n left join w using (user_id) where k = 1 and n.ts >= coalesce(w.whole, n.ts)
""")
def accepted_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each kind of event is a tile of its user's page, purchases are renders of the whole page."""
    tiles = table(spark, sf_dir, "events").select("user_id", F.when(F.col("event_type") != "purchase", F.col("event_type")).alias("tile"), F.struct("ts", "event_id").alias("g"), "event_id", "event_type", "ts")
    kept = requests.accept_tiles(tiles.withColumn("g", F.col("ts")), ["user_id", "tile"], "g")
    return kept.select("user_id", "event_type", "event_id")


@query("""
select o_custkey, case when max(floor(o_totalprice)::bigint) % 2 = 0 then 'swap' else 'rebuild' end as action, case when max(floor(o_totalprice)::bigint) % 2 = 0 then 5 else 0 end as epoch from orders group by 1
""")
def reloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as documents, orders as pages: every second document comes back with a page of another size."""
    w = Window.partitionBy("o_custkey")
    price = F.floor("o_totalprice")
    old = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("page"), F.lit(612.0).alias("width"), price.alias("height"), F.lit(4).alias("epoch"))
    new = old.withColumn("width", F.when((F.max("height").over(w) % 2 != 0) & (F.col("height") == F.max("height").over(w)), F.lit(1.0)).otherwise(F.col("width"))).drop("epoch")
    return editing.reloads(old, new, ["o_custkey"], "epoch")


@query("select event_id from events join (select user_id, max(date_trunc('day', ts)) as epoch from events group by 1) e on e.user_id = events.user_id and date_trunc('day', ts) = epoch")
def texts_of_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts_read = table(spark, sf_dir, "events").withColumn("epoch", F.date_trunc("day", "ts"))
    epochs = texts_read.groupBy("user_id").agg(F.max("epoch").alias("epoch"))
    return editing.of_epoch(texts_read, epochs, ["user_id"], "epoch").select("event_id")


@query("""
with recursive e as (select conv_id, row_number() over (partition by conv_id order by turn) as k, turn, case turn % 3 when 0 then 'insert' when 1 then 'delete' else 'rotate' end as op, turn * 2 % 5 as page from conversations
), f as (select conv_id, 0::bigint as k, 0::bigint as seq, true as ok, 2 as n from (select distinct conv_id from e)
  union all select f.conv_id, e.k, e.turn, case op when 'insert' then page <= n when 'delete' then page < n and n > 1 else page < n end,
    n + case when op = 'insert' and page <= n then 1 when op = 'delete' and page < n and n > 1 then -1 else 0 end from f join e on e.conv_id = f.conv_id and e.k = f.k + 1)
select conv_id, seq, ok, n::int as n_pages from f where k > 0
""")
def serial_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn = F.col("turn")
    edits = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(turn % 3 == 0, "insert").when(turn % 3 == 1, "delete").otherwise("rotate").alias("op"), (turn * 2 % 5).cast("int").alias("page"))
    return editing.serial_edits(edits, ["conv_id"], "turn", F.lit(2))


@query("""
with recursive e as (select user_id, row_number() over (partition by user_id order by ts, event_id) as k, event_id::varchar as v, case event_type when 'click' then 'undo' when 'view' then 'redo' else 'edit' end as op from events
), f as (select user_id, 0::bigint as k, null::varchar as now, []::varchar[] as u, []::varchar[] as r from (select distinct user_id from e)
  union all select f.user_id, e.k, case when op = 'edit' then v when op = 'undo' and len(u) > 0 then u[-1] when op = 'redo' and len(r) > 0 then r[-1] else now end,
    case when op = 'edit' then list_append(u, now) when op = 'undo' and len(u) > 0 then u[:-2] when op = 'redo' and len(r) > 0 then list_append(u, now) else u end,
    case when op = 'edit' then [] when op = 'undo' and len(u) > 0 then list_append(r, now) when op = 'redo' and len(r) > 0 then r[:-2] else r end from f join e on e.user_id = f.user_id and e.k = f.k + 1)
select user_id, now as version, len(u)::int as n_undo, len(r)::int as n_redo from f where k = (select max(k) from e where e.user_id = f.user_id)
""")
def version_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("event_type")
    log = table(spark, sf_dir, "events").select("user_id", F.struct("ts", "event_id").alias("seq"), F.when(t == "click", "undo").when(t == "view", "redo").otherwise("edit").alias("op"), F.col("event_id").cast("string").alias("version"))
    return editing.version_history(log, ["user_id"], "seq", keep=1_000_000)


@query("""
with recursive e as (select user_id, row_number() over (partition by user_id order by ts, event_id) as k, case event_id % 3 when 0 then 'move' when 1 then 'rotate' else 'delete' end as op, (event_id % 4)::int as page, (event_id % 3)::int as arg from events
), l as (select user_id, k, op, page, case when op = 'rotate' then (arg + 1) * 90 else arg end as arg from e
), f as (select user_id, 0::bigint as k, ['0:0', '1:0', '2:0']::varchar[] as p from (select distinct user_id from l)
  union all select f.user_id, l.k, case when page >= len(p) then p when op = 'delete' then case when len(p) > 1 then list_concat(p[1:page], p[page + 2:]) else p end
    when op = 'rotate' then list_concat(list_append(p[1:page], string_split(p[page + 1], ':')[1] || ':' || (string_split(p[page + 1], ':')[2]::int + arg) % 360), p[page + 2:])
    when arg >= len(p) then p else list_concat(list_append((list_concat(p[1:page], p[page + 2:]))[1:arg], p[page + 1]), (list_concat(p[1:page], p[page + 2:]))[arg + 1:]) end
  from f join l on l.user_id = f.user_id and l.k = f.k + 1)
select user_id, array_to_string(p, ',') as pages from f where k = (select max(k) from l where l.user_id = f.user_id)
""")
def page_edits_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as moves, turns and deletions of the pages of a user's book of three."""
    n = F.col("event_id")
    edits = table(spark, sf_dir, "events").select("user_id", F.struct("ts", "event_id").alias("seq"), F.element_at(F.array(*map(F.lit, ["move", "rotate", "delete"])), (n % 3 + 1).cast("int")).alias("op"), (n % 4).cast("int").alias("page"), F.when(n % 3 == 1, (n % 3 + 1) * 90).otherwise(n % 3).cast("int").alias("arg"))
    shown = F.array_join(F.transform("pages", lambda p: F.concat_ws(":", p["page"], p["turn"])), ",")
    return sets.fold_page_edits(edits, ["user_id"], "seq", F.lit(3)).select("user_id", shown.alias("pages"))


@query("""
with l as (select conv_id, turn, role, row_number() over (partition by conv_id order by turn) - 1 as k from conversations)
select conv_id, k as line, case when role = 'system' or (role = 'user' and k > 0) then 'keep' else 'para' end as action, k as item from l
""")
def editor_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as an editor's lines: systems' are locked, users' are as they were but for the first line, assistants' are changed."""
    k = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    turns = table(spark, sf_dir, "conversations").withColumn("k", k)
    kind = F.when(F.col("role") == "assistant", "list").otherwise("normal")
    items = turns.select("conv_id", F.col("k").alias("item"), kind.alias("kind"), F.lit(0).alias("level"), F.md5("text").alias("look"))
    changed = (F.col("role") == "assistant") | (F.col("k") == 0)
    lines_ = turns.select("conv_id", F.col("k").alias("line"), F.array("k").alias("origins"), F.when(F.col("role") == "system", F.col("k")).alias("locked_item"), kind.alias("kind"), F.lit(0).alias("level"), F.md5(F.concat("text", F.when(changed, "+").otherwise(""))).alias("look"))
    return sets.editor_lines(lines_, items, ["conv_id"]).select("conv_id", F.col("line").cast("long").alias("line"), "action", F.col("item").cast("long").alias("item"))


@query("""
with s as (select conv_id, turn, text, greatest(conv_id % 3, 0) as a, 2 + conv_id % 2 as b from conversations where text is not null
), p as (select *, case when turn = least(a, b) then case when a <= b then 3 else 12 end else 0 end as f, case when turn = greatest(a, b) then least(case when a <= b then 12 else 3 end, length(text)) else length(text) end as t from s where turn between least(a, b) and greatest(a, b))
select conv_id, md5(string_agg(substr(text, (f + 1)::int, (t - f)::int), chr(10) order by turn)) as digest from (select * from p where a <> b union all select * exclude (f, t), 3, least(12, length(text)) from p where a = b) where f < t group by conv_id
""")
def selected_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is selected from a place on one turn to a place on another, which depend on the conversation."""
    pages = table(spark, sf_dir, "conversations").where("text is not null").withColumn("n", F.length("text"))
    conv = F.col("conv_id")
    held = editing.selection(pages, "turn", "n", (conv % 3, 3), (conv % 2 + 2, 12), "text")
    return editing.selected_text(held, ["conv_id"], "turn").select("conv_id", F.md5("text").alias("digest"))
