"""SQL for the text operators, written for a SQL engine of its own: what the native expressions must agree with."""

from __future__ import annotations

WS = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
EOL = r"\r\n|[\n\x0b\f\r\x1c-\x1e\x{85}\x{2028}\x{2029}]"
LF = "chr(10)"
ENDS, SOFT = "。！？.!?；;", ",，、:："


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def sub(x: str, pattern: str, by: str) -> str:
    return f"regexp_replace({x}, '{pattern}', {by}, 'g')"


def chain(x: str, rules: tuple) -> str:
    for pattern, by in rules:
        x = sub(x, pattern, by)
    return x


def newlines(x: str) -> str:
    x = sub(f"coalesce({x}, '')", r"\r\n?", LF)
    return f"replace(replace(replace({x}, chr(160), ' '), chr(8211), '-'), chr(8212), '--')"


def collapsed(x: str) -> str:
    lines = f"list_transform(string_split_regex({x}, '{EOL}'), lambda s: {strip(sub('s', '[ \\t]+', chr(39) + ' ' + chr(39)))})"
    whole = sub(f"array_to_string({lines}, {LF})", r"^\n+|\n+$", "''")
    return f"array_to_string(list_transform(string_split_regex({whole}, '\\n\\n+'), lambda p: replace(p, {LF}, ' ')), {LF} || {LF})"


def entities(x: str) -> str:
    """Those that the test tables hold."""
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        x = f"replace({x}, '{name}', '{char}')"
    return x


def cleaned(x: str) -> str:
    before = (
        (r"(?s)```.*?```", LF), (r"(?m)^(?: {4}|\t).*$", "''"), (r"!\[([^\]]*)\]\([^)]+\)", r"'\1'"), (r"\[([^\]]+)\]\([^)]+\)", r"'\1'"),
        (rf"https?://[^{WS}]+", "''"), ("<[^>]+>", "' '"))
    after = (
        (rf"(?m)^[{WS}]{{0,3}}#{{1,6}}[{WS}]*", LF), (rf"(?m)^[{WS}]*[-*+][{WS}]+", "''"), (rf"(?m)^[{WS}]*\p{{Nd}}+[.)][{WS}]+", "''"),
        (rf"(?m)^[{WS}]*>[{WS}]?", "''"), ("`([^`]+)`", r"'\1'"), (r"[*_~]{1,3}([^*_~]+)[*_~]{1,3}", r"'\1'"))
    return collapsed(chain(entities(chain(newlines(x), before)), after))


#: Compatibility forms of the characters that the test tables hold.
FORMS = (("：", ":"), ("，", ","), ("？", "?"), ("！", "!"), ("；", ";"), ("（", "("), ("）", ")"), ("％", "%"), ("½", "1⁄2"), ("¼", "1⁄4"), ("¾", "3⁄4"), ("™", "TM"), ("µ", "μ"), ("º", "o"), ("ª", "a"), ("…", "..."), ("²", "2"), ("³", "3"), ("　", " "), (" ", " "), ("\u00b9", "1"), ("\u00b8", " \u0327"), ("\u00a8", " \u0308"), ("\u00b4", " \u0301"), ("\u02dc", " \u0303"), ("\u00af", " \u0304"), ("℃", "°C"), ("″", "′′"), ("ⁿ", "n"), ("㈠", "(一)"), ("㈡", "(二)"), ("㈢", "(三)"), ("㈣", "(四)"),
         ("ｃ", "c"), ("ｅ", "e"), ("ｏ", "o"), ("︺", "〕"), ("︾", "》"), ("﹂", "」"))


def compatible(x: str) -> str:
    for char, by in FORMS:
        x = f"replace({x}, '{char}', '{by}')"
    return f"nfc_normalize({x})"


def scripted(x: str) -> str:
    """The script of a cleaned text, in English."""
    return strip(chain(compatible(x), (
        (r"\[\^?[^\]]+\]", "''"), (rf"[{WS}]*--+[{WS}]*", "', '"), (rf"[{WS}]*[-=]{{3,}}[{WS}]*", f"{LF} || {LF}"), (r"[/\\]", "' '"), (r"[_#>*`|{}\[\]()<]", "' '"),
        (rf"[{WS}]+([,.;:!?，。！？；：])", r"'\1'"), (r"[ \t]+", "' '"), (r"\n{3,}", f"{LF} || {LF}"))))


def slug(title: str, fallback: str) -> str:
    x = f"lower({strip(compatible(f'coalesce({title}, {chr(39) * 2})'))})"
    x = chain(x, ((rf"[^\p{{L}}\p{{N}}_.\-{WS}]+", "''"), (rf"[_{WS}\-]+", "'-'"), (r"^[.\-]+|[.\-]+$", "''")))
    return f"coalesce(nullif({x}, ''), {fallback}, '')"


def file_name(title: str) -> str:
    x = strip(compatible(f"coalesce({title}, '')"))
    x = strip(sub(sub(x, r'[/\\:*?"<>|]+', "' '"), rf"[{WS}]+", "' '"))
    return f"coalesce(nullif({x}, ''), 'Untitled')"


# Marks for tags: a block's edge, any other tag, an item's sign.
_EDGE, _TAG, _ITEM = "\x01", "\x02", "\x03"
_BLOCKS = "article|aside|blockquote|br|dd|div|dl|dt|figcaption|figure|footer|h1|h2|h3|h4|h5|h6|header|li|main|nav|ol|p|pre|section|table|td|th|tr|ul"


def page_text(x: str) -> str:
    """Readable text of a page: blank texts between tags count for nothing, a block's edge ends a line that is not ended."""
    x = chain(x, ((r"(?s)<!--.*?-->", "''"), ("<![^>]*>", "''"), *((rf"(?is)<{t}\b[^>]*>.*?</{t}\s*>", f"'{_TAG}'") for t in ("script", "style", "svg", "noscript", "template", "title"))))
    x = chain(x, (
        (r"(?i)<li(?:\s[^>]*)?>", f"'{_EDGE}{_ITEM}'"), (rf"(?i)</?(?:{_BLOCKS})(?:[\s/][^>]*)?>", f"'{_EDGE}'"), ("</?[a-zA-Z][^>]*>", f"'{_TAG}'")))
    gap = rf"([{_EDGE}{_TAG}{_ITEM}])[{WS}]+([{_EDGE}{_TAG}{_ITEM}])"
    x = chain(x, ((gap, r"'\1\2'"), (gap, r"'\1\2'"), (rf"^[{WS}]+([{_EDGE}{_TAG}{_ITEM}])", r"'\1'"), (rf"([{_EDGE}{_TAG}{_ITEM}])[{WS}]+$", r"'\1'"), (_TAG, "''"),
                  (f"^{_EDGE}+", "''"), (rf"\n{_EDGE}+", LF), (f"{_EDGE}+", LF), (_ITEM, "'- '")))
    return collapsed(entities(x))


def page_title(x: str) -> str:
    inner = lambda tag: f"array_to_string(list_transform(regexp_extract_all({x}, '(?is)<{tag}(?:\\s[^>]*)?>(.*?)</{tag}\\s*>', 1), lambda h: regexp_replace(h, '<[^>]*>', ' ', 'g')), ' ')"
    flat = lambda tag: entities(strip(sub(inner(tag), rf"[{WS}]+", "' '")))
    return f"coalesce(nullif({flat('h1')}, ''), nullif({flat('title')}, ''))"


def segments(source: str, key: str) -> str:
    """CTEs that end in ``seg(key, segment_index, text, why)``, from ``source(key, script, t, m)``. The first needs ``WITH RECURSIVE``."""
    cut = f"list_filter(list_transform(range(0, length(b), m), lambda o: {strip('substr(b, CAST(o AS INT) + 1, m)')}), lambda q: q <> '')"
    joined = f"CASE WHEN cur = '' THEN {strip('ps[i + 1]')} WHEN ps[i + 1] = '' THEN {strip('cur')} ELSE {strip(strip('cur') + chr(32) + '||' + chr(32) + chr(39) + ' ' + chr(39) + ' || ' + strip('ps[i + 1]'))} END"
    return rf"""
x AS (SELECT {key}, least(t, m) AS t, m, {strip(sub(sub("coalesce(script, '')", "[ \t]+", "' '"), r"\n{3,}", f"{LF} || {LF}"))} AS s FROM {source}),
pa AS (SELECT {key}, t, m, unnest(string_split_regex(s, '\n[{WS}]*\n')) AS p, generate_subscripts(string_split_regex(s, '\n[{WS}]*\n'), 1) AS pno FROM x),
pb AS (SELECT {key}, t, m, {strip('p')} AS p, pno FROM pa),
pc AS (SELECT *, length(p) <= 48 AND NOT regexp_matches(p, '[{ENDS}]$') AS head, list_filter(list_transform(regexp_extract_all(p, '[^{ENDS}]+[{ENDS}]?'), lambda q: {strip('q')}), lambda q: q <> '') AS qs FROM pb WHERE p <> ''),
pd AS (SELECT {key}, t, m, pno, head, CASE WHEN head OR len(qs) = 0 THEN [p] ELSE qs END AS qs FROM pc),
pq AS (SELECT {key}, t, m, pno, head, unnest(qs) AS q, generate_subscripts(qs, 1) AS qno FROM pd),
fo({key}, t, m, pno, head, qno, toks, i, done, buf) AS (
  SELECT {key}, t, m, pno, head, qno, regexp_extract_all(q, '[{SOFT}]|[^{SOFT}]+'), 0, CAST([] AS VARCHAR[]), '' FROM pq WHERE length(q) > m
  UNION ALL
  SELECT {key}, t, m, pno, head, qno, toks, i + 1, CASE WHEN buf <> '' AND length(buf || toks[i + 1]) > m THEN list_append(done, buf) ELSE done END,
    CASE WHEN buf <> '' AND length(buf || toks[i + 1]) > m THEN {strip('toks[i + 1]')} ELSE {strip('buf || toks[i + 1]')} END
  FROM fo WHERE i < len(toks)
),
so AS (SELECT {key}, t, m, pno, head, qno, CASE WHEN buf <> '' THEN list_append(done, buf) ELSE done END AS bs FROM fo WHERE i = len(toks)),
sb AS (SELECT {key}, t, m, pno, head, qno, unnest(bs) AS b, generate_subscripts(bs, 1) AS bno FROM so),
sc AS (SELECT {key}, t, m, pno, head, qno, bno, CASE WHEN length(b) <= m THEN [{strip('b')}] ELSE {cut} END AS cs FROM sb),
pt AS (
  SELECT {key}, t, pno, head, qno, 0 AS bno, 0 AS cno, q AS part, 'sentence' AS why FROM pq WHERE length(q) <= m
  UNION ALL
  SELECT {key}, t, pno, head, qno, bno, generate_subscripts(cs, 1), unnest(cs), 'soft' FROM sc
),
pl AS (SELECT {key}, t, pno, head, list(part ORDER BY qno, bno, cno) AS ps, list(why ORDER BY qno, bno, cno) AS ws FROM pt GROUP BY {key}, t, pno, head),
ga({key}, t, pno, head, ps, ws, i, outs, outw, cur, why) AS (
  SELECT {key}, t, pno, head, ps, ws, 0, CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]), '', 'sentence' FROM pl
  UNION ALL
  SELECT {key}, t, pno, head, ps, ws, i + 1,
    CASE WHEN cur <> '' AND length({joined}) > t THEN list_append(outs, cur) ELSE outs END, CASE WHEN cur <> '' AND length({joined}) > t THEN list_append(outw, why) ELSE outw END,
    CASE WHEN cur <> '' AND length({joined}) > t THEN ps[i + 1] ELSE {joined} END, ws[i + 1]
  FROM ga WHERE i < len(ps)
),
gb AS (SELECT {key}, pno, head, CASE WHEN cur <> '' THEN list_append(outs, cur) ELSE outs END AS outs, outw FROM ga WHERE i = len(ps)),
gc AS (SELECT {key}, pno, head, outw, len(outs) AS n, unnest(outs) AS text, generate_subscripts(outs, 1) AS sno FROM gb),
seg AS (
  SELECT {key}, CAST(row_number() OVER (PARTITION BY {key} ORDER BY pno, sno) AS INT) AS segment_index, text,
    CASE WHEN sno < n THEN outw[sno] WHEN head THEN 'heading' ELSE 'paragraph' END AS why FROM gc
)"""


PAUSE = "CASE why WHEN 'heading' THEN 900 WHEN 'paragraph' THEN 800 WHEN 'soft' THEN 180 ELSE 450 END"
IS_PAGE = "contains(lower(coalesce(media_type, '')), 'html') OR coalesce(regexp_matches(lower(substr(raw_text, 1, 500)), '<html|<body|</p>|<article'), false)"

CLEAN_TEXT = f"SELECT doc_id, {cleaned('text')} AS clean_text FROM documents"
SCRIPT_AUDIT = f"""
WITH c AS (SELECT doc_id, coalesce(text, '') AS text, {cleaned('text')} AS clean FROM documents), s AS (SELECT doc_id, text, {scripted('clean')} AS script FROM c)
SELECT doc_id, script, 'en' AS language, script <> text AS changed, CAST(length(text) AS INT) AS source_chars, CAST(length(script) AS INT) AS script_chars FROM s
"""
SLUGS = f"""
WITH s AS (SELECT seq, doc_order, {slug('title', 'doc_id')} AS slug, {file_name('title')} AS name FROM source_document)
SELECT seq, CASE WHEN doc_order IS NULL THEN slug ELSE format('{{:04d}}-{{}}', doc_order, slug) END AS slug, CASE WHEN doc_order IS NULL THEN name ELSE doc_order || '. ' || name END AS file_title FROM s
"""
PAGE_LINKS = r"""
WITH p AS (
  SELECT seq, regexp_extract(source_url, '^\s*([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)', ['scheme', 'place']) AS u, regexp_extract_all(regexp_replace(raw_text, '(?s)<!--.*?-->', '', 'g'), '<[aA]\s[^>]*href="(/[^"#]*)', 1) AS hrefs
  FROM source_document WHERE contains(lower(media_type), 'html') AND source_url <> '' AND raw_text IS NOT NULL
)
SELECT seq, CAST(generate_subscripts(hrefs, 1) - 1 AS INT) AS pos, lower(u.scheme) || '://' || u.place || unnest(hrefs) AS link FROM p
"""
_READ = f"""
r AS (SELECT seq, title, raw_text, {IS_PAGE} AS page FROM source_document),
e AS (
  SELECT seq, CASE WHEN page THEN {page_text("coalesce(raw_text, '')")} ELSE {cleaned('raw_text')} END AS clean_text,
    CASE WHEN coalesce(title, '') NOT IN ('', 'Untitled') THEN title WHEN page THEN coalesce({page_title('raw_text')}, 'Untitled') ELSE 'Untitled' END AS title, page FROM r
)"""
READABLE = f"WITH {_READ} SELECT seq, title, clean_text FROM e"
SEGMENTS = f"""
WITH RECURSIVE cfg AS (SELECT project_id, CASE WHEN target_chars > 0 THEN target_chars END AS t, CASE WHEN max_chars > 0 THEN max_chars END AS m FROM project_config),
src AS (SELECT clean_id, clean_text AS script, coalesce(t, 80) AS t, coalesce(m, 120) AS m FROM clean_document d LEFT JOIN cfg ON d.project_id = cfg.project_id),
{segments('src', 'clean_id')}
SELECT clean_id, segment_index, text, CAST(length(text) AS INT) AS chars, why AS pause_reason, {PAUSE} AS pause_after_ms FROM seg
"""
PAGE_SEGMENTS = f"""
WITH RECURSIVE {_READ},
c AS (SELECT seq, {cleaned('clean_text')} AS clean FROM e WHERE seq IN (SELECT seq FROM source_document WHERE contains(lower(media_type), 'html'))),
src AS (SELECT seq, {scripted('clean')} AS script, 80 AS t, 120 AS m FROM c),
{segments('src', 'seq')}
SELECT seq, count(*) AS segments, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(sum({PAUSE}) AS BIGINT) AS pause_ms, CAST(max(length(text)) AS INT) AS longest FROM seg GROUP BY seq
"""
BEST_MATCH = """
WITH t AS (SELECT list_transform(range(16), lambda i: sin(CAST(i AS DOUBLE))) AS s), c AS (SELECT list_transform(s, lambda v: v - list_avg(s)) AS tc FROM t),
n AS (SELECT tc, sqrt(list_sum(list_transform(tc, lambda v: v * v))) AS norm FROM c),
p AS (SELECT vec_id, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS e, unnest(range(len(embedding) - 15)) AS pos FROM embeddings WHERE len(embedding) >= 16),
w AS (SELECT vec_id, len(e) AS samples, pos, e[pos + 1 : pos + 16] AS win FROM p),
s AS (SELECT vec_id, samples, pos, list_inner_product(win, tc) / (norm * sqrt(greatest(list_sum(list_transform(win, lambda v: v * v)) - pow(list_sum(win), 2) / 16, 1e-12))) AS score FROM w, n),
b AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, pos) AS k FROM s),
l AS (SELECT vec_id, round(score, 6) AS score, pos AS signature_pos, greatest(0, pos - 2) AS a, samples - least(samples, pos + 18) AS z FROM b WHERE k = 1 AND score >= 0.3)
SELECT vec_id, score, signature_pos, CASE WHEN a <= 12 AND z <= 12 THEN CASE WHEN a <= z THEN 'start' ELSE 'end' END WHEN a <= 12 THEN 'start' WHEN z <= 12 THEN 'end' ELSE 'middle' END AS position FROM l
"""
_FLAT = strip(sub(sub("coalesce(text, '')", "[ \\t]+", "' '"), r"\n{3,}", f"{LF} || {LF}"))
PARAGRAPHS = rf"""
WITH t AS (SELECT doc_id, list_filter(list_transform(string_split_regex({_FLAT}, '\n[{WS}]*\n'), lambda x: {strip('x')}), lambda x: x <> '') AS ps FROM documents)
SELECT doc_id, CAST(generate_subscripts(ps, 1) - 1 AS INT) AS pos, unnest(ps) AS paragraph FROM t
"""
_TEXT = "coalesce(text, '')"
COLLAPSED = f"SELECT doc_id, {collapsed(_TEXT)} AS collapsed, {strip(sub(_TEXT, f'[{WS}]+', chr(39) + ' ' + chr(39)))} AS inline FROM documents"
