"""Records from ordered lines and positioned words."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.places import kept
from .scans import Scan, chain_starts

# Labels of the limit lines.
PROGRAMS = {"30% OF MEDIAN": "ELI", "EXTR LOW INCOME": "ELI", "VERY LOW INCOME": "VLI", "LOW-INCOME": "LI"}
SECTION_PROGRAMS = {"Section 236": "SEC236", "Sec. 221 BMIR": "SEC221_BMIR", "Section 235": "SEC235"}
#: First words of lines that are no area, before a number and as they stand, and the title that such lines hold.
NUMBERED, HEADINGS, TITLE = ("PROGRAM", "PAGE"), ("STATE:", "---"), "INCOME LIMITS"
AMI_PERCENT = {"ELI": 30, "VLI": 50, "LI": 80}
#: Lines of one file that are scanned in one task.
LINE_BLOCK = 100_000


def carried_down(df: DataFrame, header: Column, value: Column, by: Sequence[str], order: Sequence[str], out: str, block: Column | None = None) -> DataFrame:
    """Adds out: the value of the last header row at or before each row. With a block (see scans) one file is many tasks."""
    return Scan(df, by, order, block).carried({out: F.when(header, value)}).rows()


def line_block(rows: int = LINE_BLOCK) -> Column:
    """Blocks of line numbers."""
    return F.floor(F.col("line_no") / rows)


def _numbers(text: Column) -> Column:
    return F.transform(F.filter(F.split(F.trim(text), r"\s+"), lambda t: t.rlike(r"^\d+$")), lambda t: t.cast("int"))


def limit_lines(lines: DataFrame, programs: Mapping[str, str] | None = None, states: Sequence[str] | None = None) -> DataFrame:
    """(file, area, mfi, program_type, limits) from lines (file, line_no, text): `FY 2022 MFI: 73600 30% OF MEDIAN
    v1 .. v8` and continuation lines `PROGRAM v1 .. v8`, under an area line. A new area forgets the income. Fewer
    than eight numbers give no row. With `states`, only areas that are such a name count."""
    known = dict(programs or PROGRAMS)
    t = F.trim("text")
    longest = sorted(known, key=len, reverse=True)
    by_label = lambda value: F.coalesce(*[F.when(F.contains(t, F.lit(k)), value(k)) for k in longest])
    label = by_label(F.lit)
    before, after = F.trim(by_label(lambda k: F.substring_index(t, k, 1))), F.trim(by_label(lambda k: F.substring_index(t, k, -1)))
    values = _numbers(after)
    limits = label.isNotNull() & (F.size(values) > 0) & (F.size(values) == F.size(F.split(after, r"\s+")))
    head = F.split(before, r"\s+")
    data = F.coalesce(limits & (F.get(head, F.lit(0)) == "FY") & (F.get(head, F.lit(2)) == "MFI:") & (F.size(head) == 4), F.lit(False))
    cont = F.coalesce(limits & (before == ""), F.lit(False))
    first, second = F.get(F.split(t, r"\s+"), F.lit(0)), F.coalesce(F.get(F.split(t, r"\s+"), F.lit(1)), F.lit(""))
    heading = F.upper(t).contains(TITLE) | t.startswith(HEADINGS[0]) | t.startswith(HEADINGS[1])
    skip = heading | (t == "") | (first.isin(*NUMBERED) & second.rlike(r"^\d")) | (first.rlike(r"^\d+$") & second.startswith("PERSON"))
    area = ~data & ~cont & ~skip
    if states is not None:
        area = area & F.upper(t).isin(*[s.upper() for s in states])
    here = F.col("line_no").alias("at")
    heads = {"head": F.when(area, F.struct(t.alias("name"), here)), "income": F.when(data, F.struct(F.get(head, F.lit(3)).try_cast("int").alias("mfi"), here))}
    at = Scan(lines, ["file"], ["line_no"], line_block()).carried(heads).rows()
    codes = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    rows = at.filter(data | cont).filter("head is not null and income is not null and income.at > head.at")
    rows = rows.select("file", "line_no", F.col("head.name").alias("area"), F.col("income.mfi").alias("mfi"), codes[label].alias("program_type"), values.alias("limits"))
    return rows.filter(F.size("limits") >= 8).withColumn("limits", F.slice("limits", 1, 8))


def area_definition_lines(lines: DataFrame) -> DataFrame:
    """(file, state_fips, hud_area_code, hud_area_name, metro, county_fips, county_name) from `01 ALABAMA` state lines,
    `NONMETROPOLITAN` and `CBSA:` mode lines, and `NNN-County` entries. Counties outside metro areas get the code
    NCNTY<fips>N<fips>."""
    t = F.trim("text")
    metro_line = r"^CBSA:\s*(.+?)\s*-\s*(METRO\w+)"
    mode = F.when(t.rlike(metro_line) | t.rlike("(?i)^non-?metro") | t.rlike(r"^\d{2}\s+[A-Z]"), F.struct(F.nullif(F.regexp_extract(t, metro_line, 2), F.lit("")).alias("code"), F.nullif(F.regexp_extract(t, metro_line, 1), F.lit("")).alias("name")))
    rows = Scan(lines, ["file"], ["line_no"], line_block()).carried({"state_fips": F.when(t.rlike(r"^\d{2}\s+[A-Z][A-Z .]+$"), F.substring(t, 1, 2)), "mode": mode}).rows().withColumn("t", t)
    tail = F.regexp_replace("t", r"^CBSA:.*?METRO\w+\s*", "")
    part = F.explode(F.split(tail, r",?\s+(?=\d{3}-)"))
    each = rows.filter("state_fips is not null").select("file", "state_fips", "mode", part.alias("p")).filter(F.col("p").rlike(r"^\d{3}-"))
    fips = F.concat("state_fips", F.substring("p", 1, 3))
    name = F.trim(F.regexp_extract("p", r"^\d{3}-(.*?),?$", 1))
    metro = F.coalesce(F.col("mode.code").isNotNull(), F.lit(False))
    return each.select("file", "state_fips", F.coalesce("mode.code", F.concat(F.lit("NCNTY"), fips, F.lit("N"), fips)).alias("hud_area_code"), F.coalesce("mode.name", name).alias("hud_area_name"), metro.alias("metro"), fips.alias("county_fips"), name.alias("county_name"))


def merged_rows(words: DataFrame, page: Sequence[str], y: str, order: Sequence[str], within: float, block: Column | None = None) -> DataFrame:
    """Adds row_no: a new visual row begins where y is more than `within` above the one before (gap form)."""
    scan = Scan(words, page, [y, *order], block).previous("__before", y)
    return scan.counted("row_no", F.coalesce(F.col(y) - F.col("__before") > within, F.lit(True))).rows().drop("__before").withColumn("row_no", F.col("row_no").cast("int"))


def anchored_rows(words: DataFrame, page: str, y: str, within: float, block_size: float | None = None) -> DataFrame:
    """Adds row_no: a word joins the row whose first y is at most `within` above (anchor form); null without a y.

    A gap over `within` always begins a row, so pages fall into runs without such gaps. In a run each y leads to the
    first one beyond its tolerance, and what the run's first y leads to, again and again, are the rows' first ones:
    pointer doubling, in as many rounds as the logarithm of a run's rows. block_size: how much of y one task takes.
    """
    block = lambda c: None if block_size is None else F.floor(c / block_size)
    points = words.filter(F.col(y).isNotNull()).select(F.col(page).alias("page"), F.col(y).alias("y")).distinct()
    scan = Scan(points, ["page"], ["y"], block(F.col("y"))).previous("before", "y")
    opens = F.col("before").isNull() | (F.col("y") - F.col("before") > within)
    runs = kept(scan.carried({"run": F.when(opens, F.col("y"))}).rows().drop("before"))
    # from high to low: a point's tolerance meets the last y that came before it, which is the next beyond
    ends = F.array(F.struct((-F.col("y")).alias("at"), F.lit(1).alias("kind"), F.col("y").alias("seen"), F.lit(None).cast(runs.schema["y"].dataType).alias("of")), F.struct((-(F.col("y") + within)).cast(runs.schema["y"].dataType).alias("at"), F.lit(0).alias("kind"), F.lit(None).cast(runs.schema["y"].dataType).alias("seen"), F.col("y").alias("of")))
    marks = runs.select("page", "run", F.explode(ends).alias("e")).select("page", "run", "e.*")
    links = Scan(marks, ["page", "run"], ["at", "kind", "of"], block(F.col("at"))).carried({"next": F.col("seen")}).rows().filter("kind = 0")
    node = lambda c: F.struct(F.col("page"), F.col(c).alias("y")).alias("node")
    links = links.select(node("of"), F.when(F.col("next").isNotNull(), F.struct(F.col("page"), F.col("next").alias("y"))).alias("next"))
    first = chain_starts(links, runs.filter("y = run").select(node("y")), kept).select("node", F.lit(True).alias("is_first"))
    numbered = Scan(runs.withColumn("node", F.struct("page", "y")).join(first, "node", "left"), ["page"], ["y"], block(F.col("y"))).counted("row_no", F.col("is_first")).rows()
    numbered = numbered.select(F.col("node").alias("__node"), F.col("row_no").cast("int").alias("row_no"))
    return words.join(numbered, F.struct(F.col(page).alias("page"), F.col(y).alias("y")) == F.col("__node"), "left").drop("__node")


def column_bucket(x: Column, bounds: Sequence[float]) -> Column:
    """1 before the first bound, 2 before the second, and so on."""
    out = F.when(x < bounds[0], F.lit(1))
    for i, b in enumerate(bounds[1:], 2):
        out = out.when(x < b, F.lit(i))
    return out.otherwise(F.lit(len(bounds) + 1))


def widest_gap(words: DataFrame, by: Sequence[str], x: str) -> DataFrame:
    """(by, bound): the middle of the largest gap between neighbouring x of a header."""
    w = Window.partitionBy(*by).orderBy(x)
    gaps = words.withColumn("__gap", F.lead(x).over(w) - F.col(x)).filter("__gap is not null")
    return gaps.groupBy(*by).agg(F.max_by(F.col(x) + F.col("__gap") / 2, F.struct("__gap", -F.col(x))).alias("bound"))


