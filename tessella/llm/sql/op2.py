#: A private key with its END line, or else its body; what the rule takes of a short last line without padding needs to
#: look ahead, which this SQL can't.
_INFO = r"(?:[ \t\r\n>#*|;]{0,8}[A-Z][A-Za-z-]{2,20}:[^\r\n]{0,200})?" * 8
PEM = (
    r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY(?: BLOCK)?-----"
    r"(?:[^-]*(?:-{1,4}[^-]+){0,200}-----END [A-Z ]{0,40}PRIVATE KEY(?: BLOCK)?-----"
    rf"|{_INFO}(?:(?:[\\ \t\r\n>#*|;]|<br ?/?>){{0,12}}[A-Za-z0-9+/=]{{16,}})+(?:[\\ \t\r\n]{{0,8}}[A-Za-z0-9+/]{{1,15}}={{1,2}})?|)"
)
RULES = [
    ("assign", r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", "AKIA[A-Z0-9]+", 0, 18),
    ("hex", "[0-9a-f]{16,}", 0, 16),
    ("pem", PEM, 0, 0),
    ("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{5,}", 0, 0),
    ("hosting", "gh[pousr]_[A-Za-z0-9]{36,}", 0, 0),
    ("chat", "xox[abprs]-[A-Za-z0-9-]{10,}", 0, 0),
    ("cloud", "AIza[A-Za-z0-9_-]{35}", 0, 0),
]


def _spans(number: int, kind: str, pattern: str, group: int, least: int) -> str:
    p = pattern.replace("'", "''")
    return f"""
  SELECT r, {number} AS k, '{kind}' AS kind, i,
         (list_sum(list_transform(b[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::BIGINT AS s,
         length(m[i]) AS n
  FROM (SELECT r, b, m, v, unnest(range(1, len(m) + 1)) AS i
        FROM (SELECT r, string_split_regex(text, '{p}') AS b, regexp_extract_all(text, '{p}') AS m, regexp_extract_all(text, '{p}', {group}) AS v
              FROM d WHERE regexp_matches(text, '{p}')))
  WHERE length(v[i]) >= {least}"""


SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
), s AS ({" UNION ALL ".join(_spans(n, *rule) for n, rule in enumerate(RULES))}
), g AS (
  SELECT r, count(*) FILTER (WHERE k = 0) AS n_assign, count(*) FILTER (WHERE k = 1) AS n_access, count(*) FILTER (WHERE k = 2) AS n_hex,
         string_agg(kind || ':' || s || ':' || (s + n), ',' ORDER BY s, k) FILTER (WHERE k < 3) AS base,
         string_agg(kind || ':' || s || ':' || (s + n), ',' ORDER BY s, k) AS spans
  FROM s GROUP BY r
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g ON d.r = g.r
"""
