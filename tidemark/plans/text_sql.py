"""SQL, for DuckDB, of the text rules: made from the same patterns, but with lists of what stands between matches in place of lookahead."""

from __future__ import annotations

from tidemark.functions import text as X

#: White space as Unicode has it, with the four separators of ASCII.
SPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def windows(text: str, subject: str, width: int = 120) -> str:
    """A list of the `width` characters after each mention of subject."""
    s = _quoted(f"(?i){subject}")
    parts, said = f"string_split_regex({text}, {s})", f"regexp_extract_all({text}, {s})"
    after = f"list_transform(range(k + 1, len({parts}) + 1), lambda j: {parts}[j] || coalesce({said}[j], ''))"
    return f"list_transform(range(1, len({parts})), lambda k: left(array_to_string({after}, ''), {width}))"


def direction(text: str, subject: str, up: str = X.UP, down: str = X.DOWN, flat: str = X.FLAT) -> str:
    has = lambda words: f"regexp_matches(s, {_quoted(f'(?i){words}')})"
    text = f"translate({text}, chr(304) || chr(305), 'ii')"  # both fold to i
    case = f"CASE WHEN {has(flat)} THEN 'flat' WHEN {has(up)} THEN 'increased' WHEN {has(down)} THEN 'decreased' END"
    return f"coalesce(list_filter(list_transform({windows(text, subject)}, lambda s: {case}), lambda x: x IS NOT NULL)[1], 'not_stated')"


def cues(low: str, words: list[str]) -> str:
    each = " + ".join(f"(length({low}) - length(replace({low}, {_quoted(w)}, ''))) // {len(w)}" for w in words)
    return f"CAST({each} AS INTEGER)"


def bucket(count: str, limits: tuple[int, int, int]) -> str:
    return f"CASE WHEN {count} < {limits[0]} THEN 0 WHEN {count} < {limits[1]} THEN 1 WHEN {count} < {limits[2]} THEN 2 ELSE 3 END"


def claims(table: str, key: str, text: str) -> str:
    """All claims of each row of a table."""
    body = f"trim(regexp_replace(string_split_regex({text}, {_quoted(f'(?i){X.SAFE_HARBOR}')})[1], {_quoted(SPACE + '+')}, ' ', 'g'))"
    rule = lambda r: f"regexp_matches(low, {_quoted(r)})"
    guidance = " ".join(f"WHEN {rule(r)} THEN '{name}'" for name, r in X.GUIDANCE_RULES)
    flags = ", ".join(f"{rule(r)} AS {name}" for name, r in X.FLAG_RULES.items())
    earned = lambda n: f"regexp_extract(body, {_quoted(f'(?i){X.REVENUE_PCT}')}, {n})"
    return f"""
WITH b AS MATERIALIZED (SELECT {key}, {body} AS body FROM {table}), l AS MATERIALIZED (SELECT *, lower(body) AS low FROM b),
c AS MATERIALIZED (SELECT *, CASE {guidance} ELSE 'not_provided' END AS guidance_action, {direction("body", "dividend")} AS dividend, lower({earned(1)}) AS verb, TRY_CAST({earned(2)} AS DOUBLE) AS pct,
      {cues("low", X.CONFIDENT)} AS sure, {cues("low", X.CAUTIOUS)} AS wary, {cues("low", ["non-gaap"])} + {cues("low", ["adjusted"])} AS adjusted, {cues("low", X.HEDGES)} AS hedges FROM l)
SELECT {key}, {direction("body", "revenue")} AS revenue_direction, CASE WHEN verb IN ('decreased', 'declined', 'fell', 'down') THEN -pct WHEN verb <> '' THEN pct END AS revenue_yoy_pct,
  {direction("body", "(?:earnings per share|EPS)")} AS eps_direction, {direction("body", "margin")} AS margin_direction, guidance_action,
  CAST(CASE WHEN guidance_action = 'not_provided' THEN NULL WHEN regexp_matches(low, 'full[- ]year|fiscal year') THEN 4 ELSE 1 END AS INTEGER) AS guidance_horizon_quarters,
  CASE WHEN NOT contains(low, 'dividend') THEN 'not_stated' WHEN dividend = 'not_stated' THEN 'flat' ELSE dividend END AS dividend_action,
  CASE WHEN sure > wary * 2 AND sure >= 2 THEN 'confident' WHEN wary >= greatest(2, sure) THEN 'cautious' WHEN sure + wary > 0 THEN 'neutral' ELSE 'not_stated' END AS tone,
  {bucket("adjusted", (1, 6, 15))} AS non_gaap_emphasis, {bucket("hedges", (2, 6, 14))} AS hedging_intensity, {cues("low", X.MACRO)} >= 2 AS macro_headwind_cited, {flags}, 2 AS confidence
FROM c"""


def _named(pairs: dict) -> str:
    return f"map([{', '.join(map(_quoted, pairs))}], [{', '.join(map(_quoted, pairs.values()))}])"


def unescape(text: str) -> str:
    """Character references decoded: what follows each ampersand is looked at, up to the next."""
    name = "#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*"
    read = f"{{'x': x, 'name': regexp_extract(x, '^({name});?', 1), 'semi': regexp_extract(x, '^(?:{name})(;?)', 1)}}"
    number = "CASE WHEN length(p.name) > 12 THEN 0 WHEN lower(left(p.name, 2)) = '#x' THEN TRY_CAST('0x' || substr(p.name, 3) AS BIGINT) ELSE TRY_CAST(substr(p.name, 2) AS BIGINT) END"
    windows = f"map([{', '.join(str(n) for n, by in X._WINDOWS.items() if by)}], [{', '.join(_quoted(by) for by in X._WINDOWS.values() if by)}])"
    whole = f"coalesce({windows}[p.n], chr(CAST(CASE WHEN p.n IS NULL OR p.n = 0 OR p.n > 1114111 OR p.n BETWEEN 55296 AND 57343 THEN 65533 ELSE p.n END AS INTEGER)))"
    by = f"CASE WHEN p.name LIKE '#%' THEN {whole} WHEN p.semi = ';' THEN {_named({k[1:-1]: v for k, v in X.ENTITIES.items()})}[p.name] END"
    parts = f"string_split({text}, '&')"
    pieces = f"list_transform(list_transform({parts}[2:], lambda x: {read}), lambda p: {{'x': p.x, 'name': p.name, 'semi': p.semi, 'n': CASE WHEN p.name LIKE '#%' THEN {number} END}})"
    short = f"{_named(X.LEGACY)}[regexp_extract(p.x, '^(?:{X.legacy_names()})')] || substr(p.x, length(regexp_extract(p.x, '^(?:{X.legacy_names()})')) + 1)"
    decoded = f"list_transform({pieces}, lambda p: coalesce({by} || substr(p.x, length(p.name) + length(p.semi) + 1), {short}, '&' || p.x))"
    return f"{parts}[1] || array_to_string({decoded}, '')"


def markup(table: str, key: str, html: str) -> str:
    """Text of each row's markup, in as many steps as the rules have."""
    line = SPACE.replace(r"\s", r" \t\f\r").replace(r"\x1c-\x1f", "")
    preamble = X.PREAMBLE.replace(r"\d", r"\p{Nd}").replace(r"\w", r"\pL\pM\p{Nd}\p{Pc}")
    swap = lambda pattern, by, c="c", all_="g": f"regexp_replace({c}, {_quoted(pattern)}, {by}, '{all_}')"
    strip = lambda c: swap(rf"^{SPACE}+|{SPACE}+$", "''", c)
    steps = [swap(pattern, {"group": r"'\1'", "line": "chr(10)", "tab": "chr(9)", "blank": "' '"}[by]) for pattern, by in X.markup_steps()] + [unescape("c")]
    steps += ["translate(c, chr(8217) || chr(8220) || chr(8221), chr(39) || chr(34) || chr(34))", swap(r"[ \t\x{a0}]+", "' '"), swap(r"\r\n|[\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]", "chr(10)")]
    steps += [swap(rf"(?m)^{line}+|{line}+$", "''"), strip(swap(r"\n{3,}", "chr(10) || chr(10)")), strip(swap(rf"(?i)^(?:(?:{preamble})?(?:\n|\z)){{0,8}}", "''", all_=""))]
    tables = [f"s0 AS MATERIALIZED (SELECT {key}, {html} AS c FROM {table})"] + [f"s{i + 1} AS MATERIALIZED (SELECT {key}, {x} AS c FROM s{i})" for i, x in enumerate(steps)]
    return f"WITH {', '.join(tables)} SELECT {key}, c AS text FROM s{len(steps)}"
