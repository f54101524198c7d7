"""SQL pieces of the oracles."""

from __future__ import annotations

from notewell.functions import rules
from notewell.operators.fts import ACCENTED, PLAIN
from notewell.plans.fixtures import norm_sql

__all__ = ["norm_sql"]


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def tokens(norm: str) -> str:
    return f"list_filter(string_split({norm}, ' '), lambda t: length(t) >= 2)"


def trigrams(norm: str) -> str:
    return f"CASE WHEN {norm} = '' THEN []::VARCHAR[] ELSE list_distinct(list_transform(range(1, length({norm}) + 1), lambda i: substr(' ' || {norm} || ' ', i::INT, 3))) END"


def jaccard(a: str, b: str) -> str:
    shared = f"len(list_intersect({a}, {b}))"
    return f"CASE WHEN len({a}) + len({b}) = 0 THEN 1.0 ELSE {shared}::DOUBLE / (len({a}) + len({b}) - {shared}) END"


def similarity(a: str, b: str) -> str:
    """Of two relations that have n, w and g."""
    return f"CASE WHEN {a}.n = {b}.n THEN 1.0 WHEN {a}.n = '' OR {b}.n = '' THEN 0.0 ELSE 0.55::DOUBLE * ({jaccard(f'{a}.w', f'{b}.w')}) + 0.45::DOUBLE * ({jaccard(f'{a}.g', f'{b}.g')}) END"


def prepared(name: str, source: str, norm: str) -> str:
    return f"{name} AS (SELECT *, list_distinct({tokens('n')}) AS w, {trigrams('n')} AS g FROM (SELECT *, {norm} AS n FROM {source}))"


def terms(text: str) -> str:
    return rf"list_filter(string_split(regexp_replace(translate(lower({text}), '{ACCENTED}', '{PLAIN}'), '[^\p{{L}}\p{{N}}]+', ' ', 'g'), ' '), lambda t: t <> '')"


def fts(phrases: dict[int, list[str]]) -> str:
    """found(query_id, row_id, matched, asked, rank), for phrases of terms by query."""
    asked = ", ".join(f"({q}, {k}, {p.split(' ') if p else []}::VARCHAR[])" for q, words in phrases.items() for k, p in enumerate(words))
    count = "len(list_filter(range(1, len({f}) - len(p) + 2), lambda i: list_slice({f}, i::INT, i::INT + len(p)::INT - 1) = p))"
    tf = " + ".join(f"CASE WHEN len(p) = 0 THEN 0 ELSE {count.format(f=f)} END" for f in ("tr", "tn"))
    return f"""terms AS (SELECT row_id, {terms("repo")} AS tr, {terms("note")} AS tn FROM memories),
 stats AS (SELECT count(*) AS rows_, avg(len(tr) + len(tn)) AS mean FROM terms),
 phrases(query_id, phrase, p) AS (VALUES {asked}),
 hits AS (SELECT query_id, phrase, row_id, len(tr) + len(tn) AS length, {tf} AS tf FROM terms, phrases),
 dfs AS (SELECT query_id, phrase, count(*) AS df FROM hits WHERE tf > 0 GROUP BY ALL),
 idfs AS (SELECT query_id, phrase, CASE WHEN ln((rows_ - df + 0.5) / (df + 0.5)) > 0 THEN ln((rows_ - df + 0.5) / (df + 0.5)) ELSE 1e-6 END AS idf FROM dfs, stats),
 found AS (SELECT query_id, row_id, count(*) AS matched, any_value(asked) AS asked, -sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))) AS rank
   FROM hits JOIN idfs USING (query_id, phrase) JOIN (SELECT query_id, count(*) AS asked FROM phrases GROUP BY 1) USING (query_id), stats WHERE tf > 0 GROUP BY query_id, row_id)"""


def says(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, {quoted('(?i)' + pattern)})"


def type_sql(text: str) -> str:
    auth, choice = says(text, rules.AUTH), says(text, rules.CHOICE)
    bonus = {"decision": f"CASE WHEN {auth} AND {choice} THEN 3 ELSE 0 END", "convention": f"CASE WHEN {auth} AND NOT {choice} THEN 2 ELSE 0 END"}
    rated = []
    for place, (kind, patterns) in enumerate(rules.TYPE_RULES.items()):
        own = " + ".join(f"CASE WHEN {says(text, p)} THEN {w} ELSE 0 END" for p, w in patterns)
        rated.append(f"{{'s': ({own}) + {bonus.get(kind, '0')}, 'o': CASE WHEN ({own}) > 0 THEN {-place} ELSE -5 END, 'k': '{kind}'}}")
    best = f"list_max([{', '.join(rated)}])"
    return f"CASE WHEN {best}.s > 0 THEN {best}.k ELSE 'convention' END"


def keyword_tags(text: str) -> str:
    found = ", ".join(f"CASE WHEN {says(text, rf'\b(?:{words})\b')} THEN '{tag}' END" for tag, words in rules.TAG_WORDS.items())
    return f"list_filter([{found}], lambda t: t IS NOT NULL)"


def identifier_tags(text: str) -> str:
    paths = f"flatten(list_transform(regexp_extract_all({text}, {quoted('(?i)' + rules.PATHS)}), lambda p: string_split(p, '/')))"
    files = rf"list_transform(regexp_extract_all({text}, {quoted('(?i)' + rules.FILES)}), lambda f: regexp_replace(f, '\.[^.]*$', ''))"
    return first_of(f"list_filter(list_transform(list_concat({paths}, {files}), lambda t: lower(t)), lambda t: length(t) >= 3)")


def salient_words(source: str) -> str:
    """salient(row_id, words) of source(row_id, note): the eight words that a note has most often."""
    stop = ", ".join(quoted(w) for w in rules.STOP_WORDS if len(w) >= 4)
    return rf"""salient AS (SELECT row_id, coalesce(words, []) AS words FROM {source} LEFT JOIN (SELECT row_id, list(w ORDER BY n DESC, translate(w, '_-/', concat(chr(1), chr(2), chr(3))), w) AS words FROM
 (SELECT row_id, w, count(*) AS n FROM (SELECT row_id, unnest(regexp_split_to_array(regexp_replace(lower(note), '[^a-z0-9\s/_-]', ' ', 'g'), '\s+')) AS w FROM {source})
  WHERE length(w) >= 4 AND w NOT IN ({stop}) GROUP BY row_id, w QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY n DESC, translate(w, '_-/', concat(chr(1), chr(2), chr(3))), w) <= 8) GROUP BY row_id) USING (row_id))"""


def first_of(items: str) -> str:
    """Distinct items, in the order of their first places."""
    return f"list_filter(list_transform(range(1, len({items}) + 1), lambda i: CASE WHEN list_position({items}, ({items})[i]) = i THEN ({items})[i] END), lambda t: t IS NOT NULL)"


def dates_sql(text: str, day: str) -> str:
    """A list of 'phrase = date'."""
    d = f"DATE '{day}'"
    month = lambda k: f"(date_trunc('month', {d}) + INTERVAL ({k}) MONTH + INTERVAL ({d[-3:-1]} - 1) DAY)::DATE"
    fixed = {
        "yesterday": f"{d} - 1", "today": d, "tomorrow": f"{d} + 1", "last week": f"{d} - 7", "next week": f"{d} + 7", "last month": month(-1), "next month": month(1),
    }
    named = ", ".join(rf"CASE WHEN regexp_matches(lower({text}), '\b{p}\b') THEN '{p} = ' || strftime({v}, '%Y-%m-%d') END" for p, v in fixed.items())
    units = "(?:days|day|weeks|week|months|month)"

    def counted(pattern: str, sign: int, name: str) -> str:
        n, unit = r"regexp_extract(m, '\d+')::INT", "regexp_extract(m, '(?:day|week|month)s?')"
        date = f"CASE WHEN {unit} LIKE 'day%' THEN {d} + {sign} * {n} WHEN {unit} LIKE 'week%' THEN {d} + {sign * 7} * {n} ELSE {month(f'{sign} * {n}')} END"
        return f"list_transform(regexp_extract_all(lower({text}), '{pattern}'), lambda m: {name.format(n=n, unit=unit)} || ' = ' || strftime({date}, '%Y-%m-%d'))"

    ago = counted(rf"\b\d{{1,3}}\s+{units}\s+ago\b", -1, "{n} || ' ' || {unit} || ' ago'")
    ahead = counted(rf"\bin\s+\d{{1,3}}\s+{units}\b", 1, "'in ' || {n} || ' ' || {unit}")
    return first_of(f"list_concat(list_filter([{named}], lambda t: t IS NOT NULL), list_concat({ago}, {ahead}))")


def boundary_replaced(text: str, old: str, new: str) -> str:
    """Without look-around: two passes, as a mark between two mentions belongs to the first alone."""
    once = lambda x: f"regexp_replace({x}, '(^|[^A-Za-z0-9_/-]){old}($|[^A-Za-z0-9_/-])', '\\1{new}\\2', 'g')"
    return once(once(text))
