"""Expressions of the SQL twins, written for the other engine's dialect on purpose: plain
pattern replacements instead of the engine's own functions."""

from __future__ import annotations

from newsloom import fixed_values as fv

BLANK = r"[\s\p{Z}\x{0B}\x{1C}-\x{1F}\x{85}]"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{BLANK}+|{BLANK}+$', '', 'g')"


def tidy(x: str) -> str:
    line = f"regexp_replace(regexp_replace({x}, '[\\n\\t]', ' ', 'g'), ' +', ' ', 'g')"
    forms = "|".join([*reversed(fv.ESCAPED_APOSTROPHES), f"[{fv.APOSTROPHES}]"])
    return f"regexp_replace({strip(line)}, {quoted(forms)}, '''', 'g')"


def tidy_title(x: str) -> str:
    return strip(f"regexp_replace(replace({tidy(x)}, '_', ' '), ' +', ' ', 'g')")


def valid(x: str) -> str:
    return f"({x} IS NOT NULL AND {x} <> '' AND NOT contains({x}, {quoted(fv.LOREM_MARK)}))"


def preprocess(x: str) -> str:
    entities = f"regexp_replace(replace({x}, '&amp;', 'and'), '&[^;]{{0,5}};', ' ', 'g')"
    return f"regexp_replace({entities}, {quoted(fv.ARCHIVE_BANNER)}, '', 'g')"


def quality_title(x: str) -> str:
    spaced = f"regexp_replace(replace({x}, '’', ''''), '[,:|\\n]', ' ', 'g')"
    return f"regexp_replace(regexp_replace({spaced}, '\\.0|\\.', ' ', 'g'), ' +', ' ', 'g')"


def quality_body(x: str) -> str:
    return f"regexp_replace(replace({x}, '’', ''''), '[.,:|\\n ]+', ' ', 'g')"


def _any_of(phrases: list[str]) -> str:
    return "|".join(f"(?:^|{BLANK}){p}(?:{BLANK}|$)" for p in phrases)


TITLE_ERROR = _any_of([*fv.TITLE_PHRASES, *fv.TITLE_NUMBERS]) + "|^error$"
BODY_ERROR = _any_of(fv.BODY_PHRASES) + rf"|don't have an account\??  ?sign up(?:{BLANK}|$)"


def decode_entities(x: str) -> str:
    pairs = [
        ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"),
        ("&#39;", "'"), ("&rsquo;", "’"), ("&#8217;", "’"), ("&lsquo;", "‘"), ("&copy;", "©"),
        ("&middot;", "·"), ("&amp;", "&"),
    ]
    for entity, character in pairs:
        x = f"replace({x}, {quoted(entity)}, {quoted(character)})"
    return x


def without_code(x: str) -> str:
    code = "|".join(rf"<{tag}\b.*?(?:</{tag}\s*>|\z)" for tag in ("script", "style", "template"))
    return f"regexp_replace({x}, {quoted(code + r'|<!--.*?(?:-->|\z)')}, '', 'gis')"


def visible(x: str, between: str = "") -> str:
    tags = f"regexp_replace({without_code(x)}, '</?[A-Za-z!?][^>]*>', {quoted(between)}, 'g')"
    return decode_entities(tags)


def titles(x: str) -> str:
    return f"regexp_extract_all({x}, '<title[^>]*>(.*?)</title>', 1, 'is')"


def bodies(x: str) -> str:
    return f"regexp_extract_all({x}, '<body[^>]*>(.*?)</body>', 1, 'is')"


def bad_title(x: str) -> str:
    test = f"t = '' OR regexp_matches({quality_title('t')}, {quoted(TITLE_ERROR)}, 'i')"
    return f"(len({titles(x)}) = 0 OR len(list_filter({titles(x)}, lambda t: {test})) > 0)"


def bad_body(x: str) -> str:
    text = visible("b")
    test = f"{text} = '' OR regexp_matches({quality_body(text)}, {quoted(BODY_ERROR)}, 'i')"
    bad = f"len(list_filter({bodies(x)}, lambda b: {test})) > 0"
    return f"(len({bodies(x)}) = 0 OR (NOT contains({x}, 'web.archive') AND {bad}))"


def rejected(x: str) -> str:
    marks = " OR ".join(
        f"contains({x}, {quoted(m)})" for m in (fv.NOT_ARCHIVED, fv.EXCLUDED, fv.NO_PERMISSION)
    )
    return f"({bad_title(x)} OR {bad_body(x)} OR {marks})"


def language(x: str) -> str:
    """Score of each language by a join-free count; ties go to the first code."""
    tokens = f"regexp_split_to_array(lower({x}), '[^\\p{{L}}]+')"
    scores = []
    for code in sorted(fv.STOP_WORDS):
        words = ", ".join(quoted(w) for w in sorted(set(fv.STOP_WORDS[code].split())))
        scores.append((code, f"len(list_filter({tokens}, lambda w: w IN ({words})))"))
    return scores


def main_text(x: str) -> str:
    furniture = "|".join(
        rf"<{tag}\b.*?</{tag}\s*>" for tag in ("nav", "header", "footer", "aside", "figure", "form")
    )
    clean = f"regexp_replace({without_code(x)}, {quoted(furniture)}, '', 'gis')"
    article = f"nullif(regexp_extract({clean}, '<article[^>]*>(.*)</article>', 1, 'is'), '')"
    body = f"nullif(regexp_extract({clean}, '<body[^>]*>(.*?)</body>', 1, 'is'), '')"
    region = f"coalesce({article}, {body}, {clean})"
    start = f"regexp_replace({region}, '^.*?<p(?:\\s[^>]*)?>', '', 'is')"
    return decode_entities(f"regexp_replace({start}, '</?[A-Za-z!?][^>]*>', ' ', 'g')")


def script_cases(x: str) -> str:
    """WHEN branches for texts without any known word."""
    return " ".join(
        f"WHEN regexp_matches({x}, '\\p{{{script}}}{{2}}') THEN '{code}'"
        for script, code in fv.SCRIPT_LANGUAGES
    )
