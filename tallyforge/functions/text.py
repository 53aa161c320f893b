"""Text scalars as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Fixed value: header of a log segment, with the sample's index.
LOG_HEADER = r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2},\d{3} - 样本 (\d+) 模型输出："


def strip(c: Column) -> Column:
    """Without white space (Unicode) at both ends; ``trim`` would take blanks only."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def without_space(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+", "")


def is_blank(c: Column) -> Column:
    return ~c.rlike(r"(?U)\S")


def strip_quotes(c: Column) -> Column:
    """Without any single or double quotes at both ends."""
    return F.btrim(c, F.lit("\"'"))


def extracted(c: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match; null if there is none, unlike ``regexp_extract``."""
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, group))


def count_of(c: Column, what: str) -> Column:
    """Occurrences of a string that don't overlap."""
    return ((F.length(c) - F.length(F.replace(c, F.lit(what), F.lit("")))) / F.lit(len(what))).cast("int")


def marked_answer(answer: Column) -> Column:
    """The number after ``####``, up to the first character that isn't part of a plain number; no sign, no commas."""
    return extracted(answer, r"####\s*(\d+(?:\.\d+)?)")


def digits_after_mark(answer: Column) -> Column:
    """What follows the last ``####``, digits, points and minus signs only; so 1,080 is 1080."""
    return F.regexp_replace(F.element_at(F.split(answer, "####"), -1), r"[^0-9.\-]+", "")


def numbers_in(c: Column) -> Column:
    """All numbers in order; only decimals keep their sign."""
    return F.regexp_extract_all(c, F.lit(r"([-+]?\d*\.\d+|\d+)"), F.lit(1))


def words(c: Column) -> Column:
    """Lower-case words between white space (Unicode)."""
    return F.filter(F.split(F.lower(c), r"(?U)\s+"), lambda x: x != "")


def log_index(line: Column) -> Column:
    """The sample index of a header line, else null."""
    return extracted(line, LOG_HEADER).cast("long")


def log_line(index: Column, text: Column) -> Column:
    return F.concat(index.cast("string"), F.lit(" 模型输出："), text)


def around(c: Column, mark: str) -> tuple[Column, Column]:
    """What is before and after the first mark; both null without one."""
    pair = F.split(c, mark, 2)
    return F.when(c.contains(mark), pair[0]), F.when(c.contains(mark), pair[1])


def after_last(c: Column, mark: str) -> Column:
    return F.substring_index(c, mark, -1)


def after_prompt(c: Column, prompt: Column) -> Column:
    """A generation without the prompt's length in front, stripped."""
    return strip(F.substr(c, F.length(prompt) + 1))


def preview(c: Column, n: int) -> Column:
    return F.left(c, F.lit(n))


def sanitized_name(c: Column) -> Column:
    return F.regexp_replace(c, r"[^0-9a-zA-Z_\-+.]", "_")


def with_suffix(path: Column, suffix: str = "_filtered") -> Column:
    """A path with the suffix before its extension, or at its end without one; leading points aren't an extension."""
    return F.when(path.rlike(r"[^./][^/]*\.[^./]*$"), F.regexp_replace(path, r"(\.[^./]*)$", f"{suffix}$1")).otherwise(F.concat(path, F.lit(suffix)))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def model_label(path: Column, tuned: Column) -> Column:
    """The last part of a model's path, with a prefix for tuned ones."""
    return F.concat(F.when(tuned, F.lit("finetuned-")).otherwise(F.lit("")), base_name(path))


def encoded(c: Column) -> Column:
    """Base64 on one line."""
    return F.replace(F.base64(c.cast("binary")), F.lit("\r\n"), F.lit(""))


def task_list(suite: str, tasks: Column, shots: int = 0) -> Column:
    """``suite|task|shots|0`` for each task of a comma-separated list, joined by commas."""
    return F.array_join(F.transform(F.split(tasks, ","), lambda t: F.concat(F.lit(f"{suite}|"), t, F.lit(f"|{shots}|0"))), ",")


def parameter_count(name: Column) -> Column:
    """The largest size in a model's name, such as 42m, 1.5b or 8x7b (a product); -1 without one."""
    pattern = r"((\d+(?:\.\d+)?)(?:x(\d+(?:\.\d+)?))?)([bm])"
    low = F.lower(name)
    part = lambda g: F.regexp_extract_all(low, F.lit(pattern), F.lit(g))
    sizes = F.zip_with(
        F.zip_with(part(2), part(3), lambda a, b: a.cast("double") * F.when(b == "", F.lit(1.0)).otherwise(b.try_cast("double"))),
        part(4),
        lambda n, unit: n * F.when(unit == "b", F.lit(1e9)).otherwise(F.lit(1e6)),
    )
    return F.coalesce(F.array_max(sizes).cast("long"), F.lit(-1).cast("long"))


def last_code_block(c: Column, language: str = "python") -> Column:
    """The last fenced block of a language; empty without one."""
    return F.coalesce(F.try_element_at(F.regexp_extract_all(c, F.lit(rf"(?sd)```{language}\n(.*?)```"), F.lit(1)), F.lit(-1)), F.lit(""))
