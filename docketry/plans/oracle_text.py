"""SQL of the text-shaped queries: titles, dates, white space, summaries, messages."""

from __future__ import annotations

from .. import rules
from .oracle import P, SCORED, _ACTIONS, _q

_WS = r"[\s\x0B\x1c-\x1f\x{85}\p{Z}]"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


LABEL = (
    "CASE {0} WHEN 'RBI' THEN 'Reserve Bank of India' WHEN 'SEBI' THEN 'Securities and Exchange Board of India' "
    "WHEN 'FDA' THEN 'U.S. Food and Drug Administration' WHEN 'EU_AI_ACT' THEN 'European Union AI Act' ELSE {0} END"
)
_LABEL = LABEL.format("jurisdiction")
_MONTH = "CASE lower(x.mon) " + " ".join(f"WHEN '{form}' THEN {i}" for i, m in enumerate(rules.MONTHS, 1) for form in dict.fromkeys([m, m[:3], *(["sept"] if i == 9 else [])])) + " END"
_EDGE_A, _EDGE_B = r"(^|[^\p{L}\p{N}_])", r"($|[^\p{L}\p{N}_])"


def _date(pattern: str, names: list[str], month: str = "x.m") -> str:
    listed = "['e', " + ", ".join(f"'{n}'" for n in names) + ", 'f']"
    return (
        f"(SELECT strftime(try_cast(x.y || '-' || lpad(CAST({month} AS VARCHAR), 2, '0') || '-' || lpad(x.d, 2, '0') AS DATE), '%Y-%m-%d') "
        f"FROM (SELECT regexp_extract(clean_text, {_q(pattern)}, {listed}) AS x))"
    )


TEXT = {
    "resolve_title": f"SELECT DISTINCT id, left(coalesce(nullif({_strip('title')}, ''), list_filter(list_transform(string_split(content, chr(10)), lambda x: {_strip('x')}), lambda x: x <> '')[1], {_LABEL} || ' document'), 512) AS resolved_title FROM raw_documents WHERE content_format = 'text'",
    "published_date": "SELECT id, coalesce("
    + ", ".join(
        (
            _date(_EDGE_A + r"(\d{4})-(\d{1,2})-(\d{1,2})" + _EDGE_B, ["y", "m", "d"]),
            _date(_EDGE_A + r"(\d{1,2})[/-](\d{1,2})[/-](\d{4})" + _EDGE_B, ["d", "m", "y"]),
            _date(r"(?i)" + _EDGE_A + r"(\d{1,2})(?:st|nd|rd|th)?\s+([A-Za-z]+),?\s+(\d{4})" + _EDGE_B, ["d", "mon", "y"], _MONTH),
            _date(r"(?i)" + _EDGE_A + r"([A-Za-z]+)\s+(\d{1,2})(?:st|nd|rd|th)?,?\s+(\d{4})" + _EDGE_B, ["mon", "d", "y"], _MONTH),
        )
    )
    + f") AS published FROM {P}",
    "whitespace_normalize": (
        "SELECT id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(translate(regexp_replace(clean_text, '\\r\\n?', chr(10), 'g'), "
        f"{_q(rules.SPACES + rules.ZERO_WIDTH)}, {_q(' ' * len(rules.SPACES))}), '[ \\t\\f\\x0b]+', ' ', 'g'), '(?m)^ +| +$', '', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^[\\s\\x0b]+|[\\s\\x0b]+$', '', 'g')) AS text_md5 FROM {P}"
    ).replace("{{", "{").replace("}}", "}"),
    "action_texts": f"""WITH {SCORED}, {_ACTIONS}, txt(key, tt, dd) AS (VALUES {', '.join(f'({_q(k)}, {_q(t)}, {_q(d)})' for k, _, _, t, d in rules.ACTIONS)})
SELECT p.id, p.no, left({{T}}, 256) AS title, md5(left({{D}}, 8192)) AS description_md5 FROM planned p JOIN txt USING (key) JOIN s ON s.id = p.id""",
}
for _name, _column in (("{T}", "tt"), ("{D}", "dd")):
    _filled = _column
    for _key, _value in (("doc_type", "'document'"), ("title", "coalesce(nullif(s.title, ''), 'Untitled')"), ("reference", "coalesce(nullif(s.reference_number, ''), 'N/A')"), ("jurisdiction", LABEL.format('s.jurisdiction')), ("risk_level", "upper(s.risk_level)")):
        _filled = f"replace({_filled}, '{{{_key}}}', {_value})"
    TEXT["action_texts"] = TEXT["action_texts"].replace(_name, _filled)
