"""Column expressions over step text. All stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from trailcast.functions import patterns as P


def unicode_regex(pattern: str) -> str:
    return "(?U)" + pattern


def matches(text: Column, pattern: str) -> Column:
    return F.coalesce(text.rlike(unicode_regex(pattern)), F.lit(False))


def count_matches(text: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(unicode_regex(pattern))), F.lit(0)).cast("bigint")


def all_matches(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(unicode_regex(pattern)), F.lit(group))


def strip(text: Column) -> Column:
    return F.btrim(F.coalesce(text, F.lit("")), F.lit(P.WHITESPACE))


def one_line(text: Column) -> Column:
    """Stripped text with every run of white space replaced by one blank."""
    return F.regexp_replace(strip(text), r"(?U)[\s\x1c-\x1f]+", " ")


def head(text: Column, n: int) -> Column:
    return F.substring(text, 1, n)


def or_empty(*candidates: Column) -> Column:
    """First candidate that is neither NULL nor empty, else the empty string."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in candidates], F.lit(""))


def family_match(action: Column, family: str) -> Column:
    return matches(action, P.FAMILIES[family])


def action_type(action: Column, flags: dict[str, Column] | None = None) -> Column:
    """Highest-priority command family; ``other`` for unmatched text, ``unknown`` for none."""
    hit = flags or {name: family_match(action, name) for name in P.FAMILIES}
    chain = F.when(strip(action) == "", F.lit("unknown"))
    for name in P.FAMILIES:
        chain = chain.when(hit[name], F.lit(name))
    return chain.otherwise(F.lit("other"))


def first_command(action: Column) -> Column:
    """First line that is neither empty nor a comment, without back quotes, at most 300 long."""
    lines = F.transform(F.split(action, P.LINE_END), lambda s: F.btrim(strip(s), F.lit("`")))
    kept = F.filter(lines, lambda s: (s != "") & ~s.startswith("#"))
    return head(F.get(kept, F.lit(0)), 300)


def file_paths(text: Column, longest_extension: bool = False) -> Column:
    pattern = P.FILE_PATH_LONGEST if longest_extension else P.FILE_PATH
    return F.array_distinct(all_matches(text, pattern))


def is_test_path(path: Column) -> Column:
    low = F.lower(path)
    base = F.element_at(F.split(low, "/"), -1)
    return (
        low.contains("/test") | low.startswith("test")
        | base.startswith("test_") | base.endswith("_test.py")
    )


def directory(path: Column) -> Column:
    return F.regexp_replace(F.when(path.contains("/"), path).otherwise("/"), r"/[^/]*$", "")


def _sum_of_numbers(text: Column, pattern: str) -> Column:
    found = all_matches(text, "(?i)" + pattern)
    return F.aggregate(
        found, F.lit(0).cast("bigint"),
        lambda total, s: total + F.coalesce(s.try_cast("bigint"), F.lit(0).cast("bigint")),
    )


def test_counts(observation: Column) -> tuple[Column, Column]:
    """(passed, failed) read from a test report; both NULL when nothing was reported."""
    summary = matches(observation, f"(?i){P.N_PASSED}|{P.N_FAILED}|{P.N_ERRORS}")
    passed_lines = count_matches(observation, P.PASSED_LINE)
    failed_lines = count_matches(observation, P.FAILED_LINE)
    passed = F.when(summary, _sum_of_numbers(observation, P.N_PASSED)).when(
        passed_lines > 0, passed_lines
    )
    failed = F.when(
        summary,
        _sum_of_numbers(observation, P.N_FAILED) + _sum_of_numbers(observation, P.N_ERRORS),
    ).when((passed_lines > 0) | (failed_lines > 0), failed_lines)
    return passed, failed


def has_traceback(observation: Column) -> Column:
    return matches(observation, P.TRACEBACK)


def has_exception(observation: Column) -> Column:
    return matches(observation, P.EXCEPTION)


def normalized_command(command: Column, action: Column, width: int) -> Column:
    return head(one_line(or_empty(command, action)), width)


def error_counts(observation: Column, chars: int = 1500) -> dict[str, Column]:
    part = head(observation, chars)
    return {name: count_matches(part, rx) for name, rx in P.ERROR_CATEGORIES.items()}


def split_message(content: Column) -> tuple[Column, Column]:
    """(thought, action) of a free-form assistant message."""
    text = F.coalesce(content, F.lit(""))
    fences = all_matches(text, P.FENCED_BLOCK)
    fenced = F.size(fences) > 0
    labelled = matches(text, P.ACTION_LABEL)
    label_thought = F.when(
        matches(text, P.THOUGHT_LABEL),
        F.regexp_extract(text, unicode_regex(P.THOUGHT_LABEL), 1),
    ).otherwise(F.regexp_replace(text, unicode_regex(P.ACTION_LABEL), ""))
    thought = (
        F.when(fenced, F.regexp_replace(text, unicode_regex(P.FENCED_BLOCK), ""))
        .when(labelled, label_thought)
        .otherwise(text)
    )
    action = (
        F.when(fenced, F.try_element_at(fences, F.lit(-1)))
        .when(labelled, F.regexp_extract(text, unicode_regex(P.ACTION_LABEL), 1))
        .otherwise(text)
    )
    return strip(thought), strip(action)


def repository(instance_id: Column) -> Column:
    """Repository part of ``{org}__{repo}-{number}``."""
    front = F.regexp_replace(instance_id, r"-[^-]*$", "")
    return F.when(F.coalesce(instance_id, F.lit("")) == "", F.lit("unknown")).otherwise(
        or_empty(front, instance_id)
    )


def last_code_block(text: Column) -> Column:
    blocks = all_matches(text, P.CODE_BLOCK)
    bare = strip(F.btrim(strip(text), F.lit("`")))
    return F.when(F.size(blocks) > 0, strip(F.try_element_at(blocks, F.lit(-1)))).otherwise(bare)


def normalized_output(text: Column) -> Column:
    """Output with trailing blanks of every line and outer white space removed."""
    lines = F.split(F.btrim(F.coalesce(text, F.lit("")), F.lit("\n")), "\n")
    return strip(F.array_join(F.transform(lines, lambda s: F.rtrim(s, F.lit(P.WHITESPACE))), "\n"))


def first_word(text: Column) -> Column:
    return F.get(F.split(one_line(text), " "), F.lit(0))


def verb_class(command: Column) -> Column:
    verb = first_word(command)
    return (
        F.when(verb.isin(P.INVESTIGATE_VERBS), F.lit("investigate"))
        .when(verb.isin(P.ACT_VERBS), F.lit("act"))
        .otherwise(F.lit("other"))
    )


def reply_command(reply: Column) -> Column:
    """First back-quoted command of a model reply, else its first line that is not chatter."""
    text = F.regexp_replace(F.coalesce(reply, F.lit("")), r"(?s)<think>.*?</think>", "")
    quoted = F.regexp_extract(text, r"`([^`]+)`", 1)
    lines = F.split(strip(text), P.LINE_END)
    clean = F.transform(lines, lambda s: strip(F.btrim(strip(s), F.lit("`"))))
    low_ok = F.filter(
        clean,
        lambda s: (s != "")
        & ~F.exists(F.array(*[F.lit(c) for c in P.CHATTER_STARTS]), lambda c: F.lower(s).startswith(c)),
    )
    fallback = strip(F.get(lines, F.lit(0)))
    return F.when(
        text.rlike(r"`([^`]+)`"), strip(F.get(F.split(strip(quoted), P.LINE_END), F.lit(0)))
    ).otherwise(F.coalesce(F.get(low_ok, F.lit(0)), fallback))


def next_command_class(emitted: Column, looped: Column) -> Column:
    """What follows a looped command: persist, recover or other."""
    said = strip(F.btrim(F.regexp_replace(one_line(emitted), r"(?U)^\$\s*", ""), F.lit("`")))
    loop = one_line(looped)
    return (
        F.when(one_line(emitted) == "", F.lit("other"))
        .when(said.startswith(loop), F.lit("persist"))
        .when(first_word(said).isin(P.PRODUCTIVE_VERBS), F.lit("recover"))
        .otherwise(F.lit("other"))
    )


def repeats_command(emitted: Column, looped: Column) -> Column:
    a, b = strip(emitted), strip(looped)
    return (head(a, 15) == head(b, 15)) | a.startswith(b) | b.startswith(a)


def clip(text: Column, n: int) -> Column:
    """White space collapsed, then cut."""
    return head(one_line(text), n)


def hash_number(*parts: Column) -> Column:
    """Portable 32-bit number of a key, for draws that any engine can repeat."""
    joined = F.concat_ws("|", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(joined), 1, 8), 16, 10).cast("bigint")


def hash_key(*parts: Column) -> Column:
    """Portable hash text of a key; sorting by it is a reproducible shuffle."""
    return F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))


def short_id(*parts: Column) -> Column:
    """First 12 hex digits of SHA-1 over the parts joined by the unit separator."""
    text = F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.substring(F.sha1(text), 1, 12)
