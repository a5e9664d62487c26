"""Text preparation and rule-based extraction as native column expressions.

Patterns carry the flags (?imdU): `d` keeps ^ and $ to line feeds, `U` makes classes Unicode.
"""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

# Markers, patterns and cue lists.
TABLE_MARKERS = [
    r"CONDENSED\s+CONSOLIDATED\s+(?:INTERIM\s+)?(?:STATEMENTS?|BALANCE)",
    r"CONSOLIDATED\s+(?:STATEMENTS?\s+OF|BALANCE\s+SHEETS?)",
    r"CONSOLIDATING\s+STATEMENTS?",
    r"RECONCILIATION\s+OF\s+(?:GAAP|NON-GAAP)",
    r"SUPPLEMENTAL\s+(?:FINANCIAL|INFORMATION|DATA)",
    r"SEGMENT\s+(?:INFORMATION|RESULTS|DATA)\s*$",
]
GUIDANCE_SECTION = (
    r"full[- ]year \d{4}\s+(?:revenues?|outlook|guidance|earnings)"
    r"|we (?:now )?expect[^.]{0,80}(?:full[- ]year|fiscal \d{4})"
    r"|(?:raising|lowering|reaffirm\w*|updating|reiterat\w*) (?:its |our )?(?:full[- ]year |fiscal )?(?:guidance|outlook)"
    r"|^[ \t]*(?:(?:business|financial|company|updated|revised|full[- ]year|fiscal|\d{4})[ \t]*){0,4}(?:outlook|guidance)[ \t]*:?[ \t]*$"
)
SAFE_HARBOR = r"forward[- ]looking statements|safe harbor|private securities litigation reform"
REVENUE_PCT = r"revenue[^.]{0,80}?\b(increased|decreased|grew|declined|rose|fell|up|down)\b[^.]{0,40}?(\d+(?:\.\d+)?)\s*(?:percent|%)"
UP = "increased|grew|rose|up|higher|improved|expanded|growth"
DOWN = "decreased|declined|fell|down|lower|contracted|decline"
FLAT = "flat|unchanged|essentially unchanged|roughly flat|in line with"
CONFIDENT = ["record", "strong", "excellent", "outstanding", "exceptional", "robust", "momentum", "pleased", "proud", "accelerating", "best-ever", "milestone"]
CAUTIOUS = ["challenging", "headwind", "soft", "softness", "difficult", "pressure", "disappointing", "weak", "slowdown", "uncertain", "cautious"]
HEDGES = ["believe", "expect", "anticipate", "may", "could", "should", "potential", "uncertain", "approximately", "estimate", "likely", "intend", "plan to"]
MACRO = ["macroeconomic", "inflation", "interest rate", "foreign exchange", "currency", "tariff", "recession", "demand environment", "geopolitical", "supply chain"]
GUIDANCE_RULES = [
    ("lowered", r"\b(lowering|lowered|reducing|reduced|cutting|cut)\b[^.]{0,60}(guidance|outlook)|\b(down|below|reduced)\b[^.]{0,30}from (its |our |the )?prior"),
    ("raised", r"\b(raising|raised|increasing|increased)\b[^.]{0,60}(guidance|outlook)|\b(up|above|increased)\b[^.]{0,30}from (its |our |the )?prior"),
    ("maintained", r"\b(reaffirm|maintain|continues to expect|reiterat)"),
    ("withdrawn", r"\b(withdraw|suspend)\w*\b[^.]{0,60}(guidance|outlook)"),
    ("initiated", r"\b(guidance|outlook|expects? .{0,30}(full[- ]year|fiscal))"),
]
FLAG_RULES = {
    "announced_buyback": r"(repurchase|buyback)[^.]{0,80}(authoriz|program|approved|increase)",
    "announced_restructuring": r"restructur|workforce reduction|layoff|cost[- ]reduction",
    "announced_impairment": r"impairment|write[- ]down|goodwill charge",
    "executive_transition": r"(appoint|nam(e|ing)|step(ping)? down|resign|transition)[^.]{0,60}(chief executive|chief financial|ceo|cfo)",
    "segment_weakness_disclosed": r"(segment|region|division|business)[^.]{0,80}(declin|weak|soft|challeng|pressure)",
    "one_time_items": r"one[- ]time|non[- ]recurring|unusual item|discrete item",
}
#: Words of which a rule's matches hold at least one, in lower case; a rule is only tried on texts with one of them.
NEEDS = {
    "lowered": ["guidance", "outlook", "prior"], "raised": ["guidance", "outlook", "prior"], "maintained": ["reaffirm", "maintain", "continues to expect", "reiterat"],
    "withdrawn": ["withdraw", "suspend"], "initiated": ["guidance", "outlook", "full-year", "full year", "fiscal"],
    "announced_buyback": ["repurchase", "buyback"], "announced_restructuring": ["restructur", "workforce reduction", "layoff", "cost"], "announced_impairment": ["impairment", "write", "goodwill charge"],
    "executive_transition": ["chief executive", "chief financial", "ceo", "cfo"], "segment_weakness_disclosed": ["segment", "region", "division", "business"], "one_time_items": ["time", "recurring", "unusual item", "discrete item"],
}
PREAMBLE = r"(?:EX-\d+(?:\.\d+)*|\d{1,3}|[\w\-.]+\.(?:html?|txt)|Document)"
BLOCK_TAGS = "p|div|tr|h[1-6]|li|ul|ol|table"
#: What stands in a tag after its name: quoted values may hold anything.
ATTRIBUTES = r"""(?:[\s/](?:[^"'>=]|=\s*"[^"]*"|=\s*'[^']*'|=|["'])*{hold})?"""
#: Named entities with their closing semicolon, as the standard library lists them.
ENTITIES = {f"&{name}": by for name, by in html5.items() if name.endswith(";")}
#: Names that are references without it, too.
LEGACY = {name: by for name, by in html5.items() if not name.endswith(";")}
#: Names that most references have; they are looked at before all others.
COMMON = "amp lt gt quot apos nbsp copy reg middot ndash mdash rsquo lsquo rdquo ldquo bull hellip".split()
#: What numeric references to the control range of Windows-1252 mean.
_WINDOWS = {n: bytes([n]).decode("cp1252", "ignore") for n in range(0x80, 0xA0)}

_BLANK = r"[\s\x1c-\x1f]"


def rstrip(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U){_BLANK}+\z", "")


def strip(c: Column) -> Column:
    return F.regexp_replace(rstrip(c), rf"(?U)\A{_BLANK}+", "")


def prepare(c: Column, max_chars: int | None = 70_000, markers: list[str] = TABLE_MARKERS, guidance: str = GUIDANCE_SECTION, least: int = 1500, carry: int = 5000) -> Column:
    """Struct text, original_chars, trimmed_at_marker, hard_truncated, guidance_recovered of a document.

    Cut at the first marker unless it stands before `least`; a guidance section lost with the rest is carried back from the start
    of its line, at most `carry` characters; then a cap at the last paragraph past four fifths of max_chars, else at max_chars.
    """
    mark = f"(?imdU)(?:{'|'.join(markers)})"
    head = F.get(F.split(c, mark, 2), F.lit(0))
    trimmed = F.coalesce(c.rlike(mark) & (F.length(head) >= least), F.lit(False))
    kept = F.when(trimmed, rstrip(head)).otherwise(c)
    gone = F.when(trimmed, F.substring(c, F.length(head) + 1, F.length(c)))
    section = strip(F.substring(F.regexp_extract(gone, rf"(?imdU)^([^\n]*?(?:{guidance})(?s:.*))", 1), 1, carry))
    recovered = F.coalesce(trimmed & ~kept.rlike(f"(?imdU)(?:{guidance})") & (section != ""), F.lit(False))
    full = F.when(recovered, F.concat(kept, F.lit("\n\n"), section)).otherwise(kept)
    cut, over = full, F.lit(False)
    if max_chars is not None:
        over = F.length(full) > max_chars
        window = F.substring(full, 1, max_chars)
        back = F.locate("\n\n", F.reverse(window))
        edge = F.when(back > 0, F.length(window) - back - 1).otherwise(-1)
        cut = F.when(over & (edge > 0.8 * max_chars), F.substring(window, F.lit(1), edge)).when(over, window).otherwise(full)
    return F.struct(strip(cut).alias("text"), F.length(c).alias("original_chars"), trimmed.alias("trimmed_at_marker"), F.coalesce(over, F.lit(False)).alias("hard_truncated"), recovered.alias("guidance_recovered"))


def count_cues(c: Column, cues: list[str]) -> Column:
    """Occurrences of the cues as substrings of the lower-cased text, without word borders."""
    return cues_in(F.lower(c), cues)


def cues_in(low: Column, cues: list[str]) -> Column:
    return sum((F.length(low) - F.length(F.replace(low, F.lit(x), F.lit("")))) / len(x) for x in cues).cast("int")


def bucket(c: Column, limits: tuple[int, int, int] = (1, 4, 9)) -> Column:
    return F.when(c < limits[0], 0).when(c < limits[1], 1).when(c < limits[2], 2).otherwise(3)


def direction_near(c: Column, subject: str, window: int = 120, up: str = UP, down: str = DOWN, flat: str = FLAT) -> Column:
    """Direction of the first mention of subject with a cue in the `window` characters after it; flat before up before down."""
    spans = F.regexp_extract_all(c, F.lit(f"(?isU){subject}(?=(.{{0,{window}}}))"), F.lit(1))
    has = lambda s, words: s.rlike(f"(?iU)(?:{words})")
    said = F.transform(spans, lambda s: F.when(has(s, flat), "flat").when(has(s, up), "increased").when(has(s, down), "decreased"))
    return F.coalesce(F.get(F.filter(said, lambda x: x.isNotNull()), F.lit(0)), F.lit("not_stated"))


def extract_claims(c: Column) -> Column:
    """The eighteen claims of a prepared text by rules, as a struct. The body before the safe harbor is made once a text."""
    body = F.trim(F.regexp_replace(F.get(F.split(c, f"(?iU){SAFE_HARBOR}", 2), F.lit(0)), r"(?U)[\s\x1c-\x1f]+", " "))
    folded = F.lower(F.translate(body, "\u017f\u212a\u0131\u0130", "skii"))  # letters that fold to ASCII ones in patterns
    once = F.array(F.struct(body.alias("body"), F.lower(body).alias("low"), folded.alias("folded")))
    return F.get(F.transform(once, lambda x: _claims(x["body"], x["low"], x["folded"])), F.lit(0))


def _claims(body: Column, low: Column, folded: Column) -> Column:
    """Patterns that cannot match without a certain word are tried only where it is. What several claims ask for is found once a text."""
    has = lambda *words: F.greatest(*[folded.contains(w) for w in words], F.lit(False))
    near = lambda subject, *words: F.when(has(*words), direction_near(body, subject)).otherwise("not_stated")
    earned = lambda group: F.when(has("revenue"), F.regexp_extract(body, f"(?iU){REVENUE_PCT}", group)).otherwise("")
    ruled = lambda name, rule: F.when(F.greatest(*map(low.contains, NEEDS[name])), low.rlike(f"(?U){rule}")).when(low.isNotNull(), False)
    guidance = F.lit(None).cast("string")
    for name, rule in GUIDANCE_RULES:
        guidance = F.coalesce(guidance, F.when(ruled(name, rule), name))
    found = {
        "guidance": F.coalesce(guidance, F.lit("not_provided")), "sure": cues_in(low, CONFIDENT), "wary": cues_in(low, CAUTIOUS), "dividend": near("dividend", "dividend"),
        "verb": F.lower(earned(1)), "value": earned(2).try_cast("double"), "adjusted": cues_in(low, ["non-gaap"]) + cues_in(low, ["adjusted"]), "hedges": cues_in(low, HEDGES),
    }
    once = F.array(F.struct(*[c.alias(n) for n, c in found.items()]))
    return F.get(F.transform(once, lambda x: _settled(low, near, ruled, **{n: x[n] for n in found})), F.lit(0))


def _settled(low, near, ruled, guidance, sure, wary, dividend, verb, value, adjusted, hedges) -> Column:
    tone = F.when((sure > wary * 2) & (sure >= 2), "confident").when(wary >= F.greatest(F.lit(2), sure), "cautious").when(sure + wary > 0, "neutral").otherwise("not_stated")
    dividend = F.when(~low.contains("dividend"), "not_stated").when(dividend == "not_stated", "flat").otherwise(dividend)
    horizon = F.when(guidance == "not_provided", F.lit(None).cast("int")).when(low.rlike("full[- ]year|fiscal year"), 4).otherwise(1)
    flags = [ruled(name, rule).alias(name) for name, rule in FLAG_RULES.items()]
    return F.struct(
        near("revenue", "revenue").alias("revenue_direction"),
        F.when(verb.isin("decreased", "declined", "fell", "down"), -value).when(verb != "", value).alias("revenue_yoy_pct"),
        near("(?:earnings per share|EPS)", "earnings per share", "eps").alias("eps_direction"), near("margin", "margin").alias("margin_direction"),
        guidance.alias("guidance_action"), horizon.alias("guidance_horizon_quarters"), dividend.alias("dividend_action"), tone.alias("tone"),
        bucket(adjusted, (1, 6, 15)).alias("non_gaap_emphasis"), bucket(hedges, (2, 6, 14)).alias("hedging_intensity"),
        (cues_in(low, MACRO) >= 2).alias("macro_headwind_cited"), *flags, F.lit(2).alias("confidence"),
    )


def legacy_names() -> str:
    return "|".join(sorted(LEGACY, key=lambda n: (-len(n), n)))


def markup_steps(hold: str = "") -> list[tuple[str, str]]:
    """(pattern, what takes its place: a word for a line feed, tab, blank or the first group) that take markup off, in order. Scripts, styles and comments go
    whole, read from left to right with the tags around them, so that none is found in another or in a quoted value. hold: what keeps
    an engine that backtracks from reading a tag in two ways."""
    more = ATTRIBUTES.format(hold=hold)
    raw = "|".join(f"<{n}{more}>.*?(?:</{n}(?:[\\s/][^>]*)?>|\\z)" for n in ("script", "style"))
    return [
        (f"(?is){raw}|<!--(?:-?>|.*?(?:--!?>|\\z))|(</?[a-z][^\\s/>]*{more}>)", "group"),
        (f"(?i)</(?:{BLOCK_TAGS}){more}>", "line"), (f"(?i)</(?:td|th){more}>", "tab"), (f"(?i)<br{more}>", "line"), (f"(?i)</?[a-z][^\\s/>]*{more}>|<[!?/][^>]*>", "blank"),
    ]


def _map(pairs: dict[str, str]) -> Column:
    """A map of constants, as one literal: a literal for each would take longer to plan than to run."""
    return F.str_to_map(F.lit("\x01".join(f"{k}\x02{v}" for k, v in pairs.items())), F.lit("\x01"), F.lit("\x02"))


def unescape(c: Column) -> Column:
    """Numeric and named character references decoded, each once; what is none stays as it is."""
    known = _map({name[1:-1]: by for name, by in ENTITIES.items()})
    common = _map({name: ENTITIES[f"&{name};"] for name in COMMON})
    legacy = _map(LEGACY)
    windows = F.create_map(*[F.lit(x) for n, by in _WINDOWS.items() if by for x in (n, by)])

    def numeric(n: Column) -> Column:
        bad = n.isNull() | (n == 0) | (n > 0x10FFFF) | n.between(0xD800, 0xDFFF)
        plain = F.decode(F.unhex(F.lpad(F.hex(F.when(bad, 0xFFFD).otherwise(n).cast("long")), 8, "0")), "UTF-32")
        return F.coalesce(F.element_at(windows, n.cast("int")), plain)

    def piece(x: Column) -> Column:
        """What follows an ampersand, up to the next."""
        name = F.regexp_extract(x, r"^(#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);?", 1)
        end = F.regexp_extract(x, r"^(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*)(;?)", 1)
        rest = F.substring(x, F.length(name) + F.length(end) + 1, F.length(x))
        hexed = F.conv(F.substring(name, F.lit(3), F.length(name)), 16, 10)
        number = F.when(F.lower(F.left(name, F.lit(2))) == "#x", hexed).otherwise(F.substring(name, F.lit(2), F.length(name))).try_cast("decimal(20,0)").try_cast("long")
        number = F.when(F.length(name) > 12, F.lit(0xFFFFFF).cast("long")).otherwise(number)
        by = F.when(F.left(name, F.lit(1)) == "#", numeric(number)).when(end == ";", F.coalesce(F.element_at(common, name), F.element_at(known, name)))
        short = F.regexp_extract(x, f"^(?:{legacy_names()})", 0)  # the longest name that needs no semicolon
        cut = F.concat(F.element_at(legacy, short), F.substring(x, F.length(short) + 1, F.length(x)))
        return F.coalesce(F.concat(by, rest), cut, F.concat(F.lit("&"), x))

    parts = F.split(c, "&")
    tail = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), piece)
    return F.when(c.contains("&"), F.concat(parts[0], F.array_join(tail, ""))).otherwise(c)


def html_to_text(c: Column) -> Column:
    """Text of markup by tag rules: scripts, styles and comments go; block ends and <br> become line feeds, cells tabs, other tags blanks; references decoded;
    quotes straightened; white space collapsed; a leading preamble of at most eight lines dropped. A `<` that begins no tag is text."""
    for pattern, by in markup_steps("+"):
        c = F.regexp_replace(c, pattern, {"group": "$1", "line": "\n", "tab": "\t", "blank": " "}[by])
    c = unescape(c)
    c = F.translate(c, "\u2019\u201c\u201d", "'\"\"")
    c = F.regexp_replace(c, "[ \\t\u00a0]+", " ")
    c = F.regexp_replace(c, "\\r\\n|[\\r\\x0b\\x0c\\x1c-\\x1e\\x85\u2028\u2029]", "\n")
    c = F.regexp_replace(c, r"(?mdU)^[\s&&[^\n]]+|[\s&&[^\n]]+$", "")
    c = strip(F.regexp_replace(c, r"\n{3,}", "\n\n"))
    return strip(F.regexp_replace(c, rf"(?iU)\A(?:(?:{PREAMBLE})?(?:\n|\z)){{0,8}}", ""))


def search_context(c: Column, pattern: str, width: int = 120, most: int = 8) -> Column:
    """The first hits of a pattern, each with up to width characters around it."""
    return F.slice(F.regexp_extract_all(c, F.lit(f"(?isU)(.{{0,{width}}}(?:{pattern}).{{0,{width}}})"), F.lit(1)), 1, most)


def content_key(*parts: Column) -> Column:
    """First 32 hex digits of the sha-256 over the parts, each followed by a zero byte."""
    zero = F.unhex(F.lit("00"))
    return F.left(F.sha2(F.concat(*[x for p in parts for x in (p.cast("binary"), zero)]), 256), F.lit(32))


def straighten_accession(c: Column) -> Column:
    return F.replace(c, F.lit("-"), F.lit(""))


def cik_name(c: Column) -> Column:
    return F.concat(F.lit("CIK"), F.lpad(c.cast("string"), 10, "0"))
