"""DuckDB (RE2) spellings of the text rules, used to write the oracle SQL.

RE2 has no look-around and an ASCII ``\\b``, so the oracle spells the same
rules differently: boundaries become ``(^|[^..])`` groups and article removal
wraps word separators in ``chr(1)`` sentinels.
"""

from __future__ import annotations

# Python whitespace, RE2 spelling.
WS = "[\\t-\\r\\x1c-\\x20\\x85\\xa0\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
WS_INNER = WS[1:-1]


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def choice(x: str) -> str:
    s = strip(x)
    lead = f"regexp_extract({s}, '^([A-Ea-e])[.):{WS_INNER}]', 1)"
    phrase = f"regexp_extract({s}, '(?i)(?:answer is|answer:){WS}*([A-Ea-e])', 1)"
    alone = f"regexp_extract({s}, '^([A-Ea-e]){WS}*$', 1)"
    return f"upper(coalesce(nullif({lead}, ''), nullif({phrase}, ''), nullif({alone}, '')))"


def choice_correct(p: str, r: str) -> str:
    picked = choice(p)
    ref_letter = choice(r)
    token = f"regexp_matches({p}, '(?i)(^|[^A-Za-z])' || {ref_letter} || '([^A-Za-z]|$)')"
    return (
        f"(CASE WHEN {picked} IS NOT NULL THEN coalesce({picked} = upper({strip(r)}), false) "
        f"ELSE coalesce({token}, false) END)"
    )


def normalize(x: str) -> str:
    s = f"lower({x})"
    s = f"regexp_replace({s}, '([^\\p{{L}}\\p{{N}}_]+)', chr(1) || '\\1' || chr(1), 'g')"
    s = f"regexp_replace({s}, '(^|' || chr(1) || ')(a|an|the)(' || chr(1) || '|$)', '\\1 \\3', 'g')"
    s = f"replace({s}, chr(1), '')"
    s = f"regexp_replace({s}, '[!-/:-@\\[-`{{-~]', '', 'g')"
    s = f"regexp_replace({s}, '{WS}+', ' ', 'g')"
    return f"regexp_replace({s}, '^ | $', '', 'g')"


def exact_match(p: str, r: str) -> str:
    return f"CAST({normalize(p)} = {normalize(r)} AS DOUBLE)"


def token_count(x: str) -> str:
    return f"len(list_filter(regexp_split_to_array({x}, '{WS}+'), lambda t: t <> ''))"


def sanitize(x: str) -> str:
    s = strip(f"CAST({x} AS VARCHAR)")
    s = f"replace({s}, '/', '-')"
    s = f"regexp_replace({s}, '[^A-Za-z0-9._-]+', '-', 'g')"
    s = f"regexp_replace({s}, '-+', '-', 'g')"
    s = f"regexp_replace({s}, '^[-.]+|[-.]+$', '', 'g')"
    return f"coalesce(nullif({s}, ''), 'unknown')"


def capitalize(x: str) -> str:
    return f"(upper(substr({x}, 1, 1)) || lower(substr({x}, 2)))"
