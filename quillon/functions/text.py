"""Text as column expressions: stripping, conversion, chunking, tables, recognition decisions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: what str.strip() removes, as a regular-expression class.
WS = r"[\x09-\x0D\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"


#: The same characters as text, made from their ranges.
WS_CHARS = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def strip(c: Column) -> Column:
    """Without Unicode white space at both ends. It looks at the ends alone, so long texts cost no more than short ones."""
    return F.btrim(c, F.lit(WS_CHARS))


def parts(c: Column) -> Column:
    """The non-blank elements of an array of strings, stripped."""
    return F.filter(F.transform(c, strip), lambda x: x != "")


def without_nul(c: Column) -> Column:
    return F.replace(c, F.lit("\x00"), F.lit(""))


def split_on(c: Column, literal: str) -> Column:
    return F.split(c, rf"\Q{literal}\E", -1)


# converters


def convert_paragraphs(c: Column) -> Column:
    """Paragraphs stripped and joined again by a blank line."""
    return F.array_join(parts(split_on(c, "\n\n")), "\n\n")


def convert_whitespace(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return strip(F.regexp_replace(c, rf"{WS}+", " "))


def convert_lines(c: Column) -> Column:
    """Lines stripped, blank ones left out. Lines end where str.splitlines() ends them."""
    return F.array_join(parts(F.split(c, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]", -1)), "\n")


# chunkers


def chunk_fixed(c: Column, size: int) -> Column:
    """Slices of size code points; an empty text is one empty slice."""
    n = F.greatest(F.char_length(c), F.lit(1))
    return F.transform(F.sequence(F.lit(0), n - 1, F.lit(size)), lambda i: F.substring(c, i + 1, F.lit(size)))


def chunk_recursive(c: Column, most: int) -> Column:
    """Paragraphs as they are if there are several, else the text whole or, if longer than most, in slices."""
    p = parts(split_on(c, "\n\n"))
    return F.when(F.size(p) > 1, p).when(F.char_length(c) <= most, F.array(c)).otherwise(chunk_fixed(c, most))


def chunk_semantic(c: Column, least: int = 0) -> Column:
    """Sentences at full stops, gathered until they have at least `least` characters; a text without any is one chunk."""
    s = parts(split_on(F.replace(c, F.lit("\n"), F.lit(" ")), "."))
    if least > 0:
        zero = F.struct(F.lit("").alias("held"), F.array().cast("array<string>").alias("out"))

        def step(a: Column, x: Column) -> Column:
            now = F.regexp_replace(F.concat(a["held"], F.lit(". "), x), r"\A[. ]+|[. ]+\z", "")
            done = F.char_length(now) >= least
            return F.struct(F.when(done, F.lit("")).otherwise(now).alias("held"), F.when(done, F.concat(a["out"], F.array(now))).otherwise(a["out"]).alias("out"))

        s = F.aggregate(s, zero, step, lambda a: F.when(a["held"] != "", F.concat(a["out"], F.array(a["held"]))).otherwise(a["out"]))
    return F.when(F.size(s) > 0, s).otherwise(F.array(c))


def clean(c: Column) -> Column:
    return parts(c)


def has_marker(c: Column) -> Column:
    """Code fences and tables, which should not be split."""
    return c.contains("```") | c.contains("<table") | c.contains("|---|")


def paragraph_blocks(c: Column) -> Column:
    return parts(split_on(F.replace(c, F.lit("\r\n"), F.lit("\n")), "\n\n"))


# document structure and tables

TABLE_POLICIES = ("table_as_text", "table_as_markdown", "table_as_html", "table_as_json", "table_dual")


def full_text(blocks: Column) -> Column:
    """Non-blank texts of the blocks, joined by blank lines."""
    return F.array_join(F.filter(F.transform(F.coalesce(blocks, F.array().cast(_BLOCKS)), lambda b: b["text"]), lambda t: strip(t) != ""), "\n\n")


_BLOCKS = "array<struct<text:string,kind:string,page:int,section_path:array<string>>>"


def headers_of(t: Column) -> Column:
    """The table's headers, or col_0, col_1 ... for the first row's cells if it has none."""
    none = F.array().cast("array<string>")
    n = F.coalesce(F.size(F.try_element_at(t["rows"], F.lit(1))), F.lit(0))
    made = F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: F.concat(F.lit("col_"), i))).otherwise(none)
    return F.when(F.coalesce(F.size(t["headers"]), F.lit(0)) > 0, t["headers"]).otherwise(made)


def _cell(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _joined(cells: Column, sep: str) -> Column:
    return F.array_join(F.transform(cells, _cell), sep)


def table_text(t: Column) -> Column:
    """Headers, if there are any, and rows; cells with tabs between them."""
    head = F.when(F.coalesce(F.size(t["headers"]), F.lit(0)) > 0, F.array(_joined(t["headers"], "\t"))).otherwise(F.array().cast("array<string>"))
    return strip(F.array_join(F.concat(head, F.transform(t["rows"], lambda r: _joined(r, "\t"))), "\n"))


def table_markdown(t: Column) -> Column:
    """A pipe table; short rows are padded with empty cells, long ones cut."""
    h = headers_of(t)
    line = lambda cells: F.concat(F.lit("| "), _joined(cells, " | "), F.lit(" |"))
    fit = lambda r: F.slice(F.concat(r, F.array_repeat(F.lit(""), F.size(h))), 1, F.size(h))
    rule = F.concat(F.lit("| "), F.array_join(F.transform(h, lambda _: F.lit("---")), " | "), F.lit(" |"))
    return F.array_join(F.concat(F.array(line(h), rule), F.transform(t["rows"], lambda r: line(fit(r)))), "\n")


def table_html(t: Column) -> Column:
    """An HTML table, a line for each row; cells stand as they are, without escapes."""
    cells = lambda r, tag: F.array_join(F.transform(r, lambda c: F.concat(F.lit(f"<{tag}>"), _cell(c), F.lit(f"</{tag}>"))), "")
    some = F.coalesce(F.size(t["headers"]), F.lit(0)) > 0
    head = F.when(some, F.array(F.concat(F.lit("  <thead><tr>"), cells(t["headers"], "th"), F.lit("</tr></thead>")))).otherwise(F.array().cast("array<string>"))
    rows = F.transform(t["rows"], lambda r: F.concat(F.lit("    <tr>"), cells(r, "td"), F.lit("</tr>")))
    return F.array_join(F.concat(F.array(F.lit("<table>")), head, F.array(F.lit("  <tbody>")), rows, F.array(F.lit("  </tbody>"), F.lit("</table>"))), "\n")


def table_json(t: Column, shape: str = "records") -> Column:
    """A table as JSON: a record for each row (cells beyond the headers are col_<i>), or headers and rows; page and locator are given even if null."""
    if shape == "rows_cols":
        body = [F.transform(F.coalesce(t["headers"], F.array().cast("array<string>")), _cell).alias("headers"), t["rows"].alias("rows")]
    else:
        h = F.coalesce(t["headers"], F.array().cast("array<string>"))

        def record(r: Column) -> Column:
            keys = F.transform(r, lambda _, i: F.coalesce(F.nullif(F.get(h, i), F.lit("")), F.concat(F.lit("col_"), i)))
            last = F.filter(F.sequence(F.lit(1), F.greatest(F.size(keys), F.lit(1))), lambda i: (i <= F.size(keys)) & ~F.array_contains(F.slice(keys, i + 1, F.greatest(F.size(keys) - i, F.lit(0))), F.get(keys, i - 1)))
            return F.map_from_arrays(F.transform(last, lambda i: F.get(keys, i - 1)), F.transform(last, lambda i: F.get(r, i - 1)))  # of a header that occurs twice the last cell counts

        body = [F.transform(t["rows"], record).alias("records")]
    return F.to_json(F.struct(*body, t["page"].alias("page"), t["locator"].alias("locator")), {"ignoreNullFields": "false"})


def render_table(t: Column, policy: str = "table_as_markdown", shape: str = "records") -> Column:
    """A table in the form of a policy; an unknown policy gives Markdown."""
    policy = policy.strip().lower()
    if policy == "table_dual":
        return F.concat(table_markdown(t), F.lit("\n\n```json\n"), table_json(t, shape), F.lit("\n```"))
    if policy == "table_as_json":
        return table_json(t, shape)
    return {"table_as_text": table_text, "table_as_html": table_html}.get(policy, table_markdown)(t)


# text recognition


def ocr_decision(mode: str, chars: Column, scanned: Column, provider: str = "", min_chars: int = 200, min_scanned: float = 0.5) -> Column:
    """Whether to recognise text: off, forced, or for short texts of documents that are mostly scanned."""
    mode = {"disabled": "disabled", "force": "force"}.get((mode or "disabled").strip().lower(), "auto")
    auto = (chars < min_chars) & (scanned >= min_scanned)
    enabled = F.lit(False) if mode == "disabled" else F.lit(True) if mode == "force" else F.coalesce(auto, F.lit(False))
    reason = F.lit(f"mode_{mode}") if mode in ("disabled", "force") else F.when(enabled, F.lit("auto_triggered")).otherwise(F.lit("auto_not_required"))
    return F.struct(enabled.alias("enabled"), F.lit(mode).alias("mode"), reason.alias("reason"), F.lit(provider).alias("provider_id"))


def within_budget(cost: Column, cap: Column) -> Column:
    return cost <= cap


def quality_passed(quality: Column, least: float) -> Column:
    """A document's confidence reaches the least; without one it counts as 1."""
    return F.coalesce(F.try_element_at(quality, F.lit("confidence")), F.lit(1.0)) >= least


def is_heading(text: Column) -> Column:
    t = strip(text)
    return t.startswith("#") & (F.char_length(t) > 1)


def invariants_passed(blocks: Column, tables: Column, min_chars: Column, need_heading: Column, need_table: Column) -> Column:
    """Enough text, and a heading and a table where they are expected."""
    text = full_text(blocks)
    enough = F.char_length(strip(text)) >= min_chars
    heading = F.exists(blocks, lambda b: (b["kind"] == "heading") | F.coalesce(is_heading(b["text"]), F.lit(False)))
    return enough & (~need_heading | F.coalesce(heading, F.lit(False))) & (~need_table | (F.coalesce(F.size(tables), F.lit(0)) > 0) | text.contains("|") | F.lower(text).contains("<table"))
