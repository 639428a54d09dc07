"""SQL that another engine can run on the same tables, by the names of :mod:`regulus.queries`.

The documents are made by the SQL the corpus is made by; what is asked of them
is worked out anew from their text. Its regular expressions have no look-around
and its own flags, so patterns are written out here (fixed values, as those of
:mod:`regulus.functions.patterns`).
"""

from __future__ import annotations

from regulus.plans.corpus import DUCKDB
from regulus.plans.render import VERSIONS

ART = r"(제\d+조(?:의\d+)?)\s*[\(\[]([^\)\]]+)[\)\]]"
TRIM = r"^\s+|\s+$"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '{TRIM}', '', 'g')"


def cte(*parts: str) -> str:
    return "WITH " + ", ".join([DUCKDB, *parts]) + " "


def segments(name: str, pattern: str, source: str = "docs", text: str = "text", keys: str = "doc_id") -> str:
    """Pieces of each text: number 0 is what stands before the first match, the others begin with one."""
    return rf"{name} AS (SELECT {keys}, unnest(range(len(s))) AS i, unnest(s) AS seg FROM (SELECT {keys}, string_split(regexp_replace({text}, '{pattern}', chr(1) || '\0', 'g'), chr(1)) AS s FROM {source}))"


ARTICLES = (
    segments("seg", ART),
    rf"""occ AS (SELECT doc_id, i, seg, regexp_extract(seg, '^{ART}', 1) AS number, regexp_extract(seg, '^{ART}', 2) AS title,
      coalesce(sum(length(seg)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM seg)""",
    "firsts AS (SELECT *, i > 0 AND row_number() OVER (PARTITION BY doc_id, number ORDER BY i) = 1 AS f FROM occ)",
    "isl AS (SELECT *, sum(f::INT) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM firsts)",
    rf"raws AS (SELECT doc_id, g - 1 AS section_order, arg_min(number, i) AS number, arg_min(title, i) AS title, min(start) AS start, string_agg(CASE WHEN f THEN regexp_replace(seg, '^{ART}', '') ELSE seg END, '' ORDER BY i) AS raw FROM isl WHERE g > 0 GROUP BY doc_id, g)",
    f"bodies AS (SELECT *, {strip("CASE WHEN section_order = max(section_order) OVER (PARTITION BY doc_id) THEN string_split(raw, '[별표')[1] ELSE raw END")} AS body FROM raws)",
)
CHAPTERS = (
    segments("cseg", r"제\s*\d+\s*장"),
    rf"""chap AS (SELECT doc_id, regexp_replace(regexp_extract(seg, '^(제\s*\d+\s*장)', 1), '\s', '', 'g') AS number, {strip(r"regexp_extract(seg, '^제\s*\d+\s*장\s*([^\n]+)?', 1)")} AS title, start FROM (
      SELECT *, coalesce(sum(length(seg)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM cseg) WHERE i > 0)""",
    "chap1 AS (SELECT doc_id, number, title, start, row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1 AS section_order FROM chap QUALIFY row_number() OVER (PARTITION BY doc_id, number ORDER BY start) = 1)",
)
ATTACHED = (
    *ARTICLES,
    *CHAPTERS,
    "arts AS (SELECT b.*, coalesce(c.number || CASE WHEN c.title <> '' THEN ' ' || c.title ELSE '' END, '') AS chapter, coalesce(c.number, '') AS chapter_number FROM bodies b ASOF LEFT JOIN chap c ON b.doc_id = c.doc_id AND b.start > c.start)",
)
CLEAN_BODY = strip(r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(body, '(?m)제\d+장\s+[가-힣\s]+$', '', 'g'), '(?m)^\.(\s*"[가-힣]+"\s*란)', '1.\1', 'g'), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g')""")
CLEANED = (*ATTACHED, f"cleaned AS (SELECT *, {CLEAN_BODY} AS clean_body FROM arts)")
KIND_DATE = r"(전부개정|일부개정|제정|개정)\s*(\d{4}\.\d{1,2}\.\d{1,2}\.?)"
AMENDMENTS = (
    # a bare date has something other than an opening bracket, or nothing, before its kind
    rf"""found AS (
      SELECT doc_id, 0 AS p, unnest(range(len(m))) AS i, unnest(m) AS m FROM (SELECT doc_id, regexp_extract_all(text, '\[{KIND_DATE}\]') AS m FROM docs)
      UNION ALL SELECT doc_id, 1, unnest(range(len(m))), unnest(m) FROM (SELECT doc_id, regexp_extract_all(text, '\({KIND_DATE}\)') AS m FROM docs)
      UNION ALL SELECT doc_id, 2, unnest(range(len(m))), unnest(m) FROM (SELECT doc_id, regexp_extract_all(text, '<{KIND_DATE}>') AS m FROM docs)
      UNION ALL SELECT doc_id, 3, unnest(range(len(m))), unnest(m) FROM (SELECT doc_id, regexp_extract_all(text, '(?:^|[^<\[\(]){KIND_DATE}') AS m FROM docs))""",
    rf"dated AS (SELECT doc_id, p, i, regexp_extract(m, '{KIND_DATE}', 1) AS kind, rtrim(regexp_extract(m, '{KIND_DATE}', 2), '.') AS amendment_date FROM found)",
    "once AS (SELECT *, row_number() OVER (PARTITION BY doc_id, amendment_date ORDER BY p, i) AS n FROM dated)",
    "amend AS (SELECT doc_id, kind, amendment_date, row_number() OVER (PARTITION BY doc_id ORDER BY CAST(split_part(amendment_date, '.', 1) AS INT) DESC, CAST(split_part(amendment_date, '.', 2) AS INT) DESC, CAST(split_part(amendment_date, '.', 3) AS INT) DESC, p, i) - 1 AS amendment_order FROM once WHERE n = 1)",
)
ANNEX = (
    rf"ann AS (SELECT * FROM (SELECT doc_id, {strip(r"regexp_extract(text, '(\[별표\s*\d+\][\s\S]+)', 1)")} AS content FROM docs) WHERE content <> '')",
)
CANON = "array_to_string(list_transform(string_split(translate(content, '□■◆◇○●▪▫◎◉★☆━┃│─├┤┬┴┼┌┐└┘', ''), chr(10)), lambda x: regexp_replace(regexp_replace(x, '[ \\t]+', ' ', 'g'), '\\s+$', '')), chr(10))"
SECTIONS = (
    *ANNEX,
    f"canon AS (SELECT doc_id, {strip(CANON)} AS t FROM ann)",
    segments("asg", r"\[별표\s*\d+\]\s*[^\n<]+", "canon", "t"),
    f"sec AS (SELECT doc_id, i - 1 AS annex_index, {strip('seg')} AS content FROM asg WHERE i > 0)",
    # a header here is its mark, and the line of the related article where there is one
    rf"""parts AS (SELECT doc_id, annex_index, regexp_extract(content, '^\[별표\s*(\d+)\]', 1) AS annex_no, {strip(r"regexp_extract(content, '^\[별표\s*\d+\]\s*([^\n<]+)', 1)")} AS annex_title,
      string_split(content, chr(10)) AS l FROM sec)""",
    "sect AS (SELECT *, CASE WHEN len(l) > 1 AND contains(l[2], '<제') THEN 2 ELSE 1 END AS h FROM parts)",
    rf"body AS (SELECT doc_id, annex_index, annex_no, annex_title, array_to_string(l[1:h], chr(10)) AS header, {strip(r"regexp_extract(array_to_string(l[1:h], chr(10)), '<(제\d+조[^>]*)관련>', 1)")} AS related_article, list_filter(l[h+1:], lambda x: x <> '') AS bl FROM sect)",
)
HINTS = "['구분', '기준', '대상', '내용', '자격', '비고', '항목', '절차', '방법', '범위', '요건', '조건', '직급', '응시자격', '승진후보자범위', '서열명부순위', '임용인원수', '경력기준']"
FEATURES = (
    *SECTIONS,
    r"""feat AS (SELECT doc_id, annex_index, list_sum(list_transform(bl, lambda x: length(regexp_replace(x, '[^0-9]', '', 'g'))))::DOUBLE / list_sum(list_transform(bl, lambda x: length(x))) AS digit_density,
      len(list_filter(bl, lambda x: length(trim(x)) < 50))::DOUBLE / len(bl) AS short_line_ratio,
      regexp_matches(bl[1], '임용하고자|서열명부|직급|응시자격|승진|제외|구분|비고|인원수|점수|평정|평가|담당자|자격취득|경력') AS header_hint FROM body)""",
)
GATE = (
    "proc AS (SELECT doc_id, text, array_to_string(list_filter(string_split(CASE WHEN doc_id % 3 = 0 THEN replace(text, '제3조(', '(') WHEN doc_id % 7 = 0 THEN text || chr(10) || '제900조(추가)' ELSE text END, chr(10)), lambda x: NOT regexp_matches(trim(x), '^(?:(?i:Page\\s+\\d+)|[-—–_]{3,})\\s*$')), chr(10)) AS processed FROM docs)",
    r"heads AS (SELECT doc_id, text, processed, list_sort(list_distinct(list_transform(regexp_extract_all(text, '제\s*\d+\s*조(?:의\s*\d+)?(?:\s*\(|\s|$)'), lambda x: regexp_replace(x, '[\s\(]', '', 'g')))) AS a, list_sort(list_distinct(list_transform(regexp_extract_all(processed, '제\s*\d+\s*조(?:의\s*\d+)?(?:\s*\(|\s|$)'), lambda x: regexp_replace(x, '[\s\(]', '', 'g')))) AS b FROM proc)",
    f"""gate AS (SELECT doc_id, a, list_sort(list_filter(a, lambda x: NOT list_contains(b, x))) AS missing, list_sort(list_filter(b, lambda x: NOT list_contains(a, x))) AS extra,
      CASE WHEN len(a) = 0 THEN 0.0 ELSE len(list_filter(a, lambda x: list_contains(b, x)))::DOUBLE / len(a) END AS match_rate,
      length({strip('processed')})::DOUBLE / length({strip('text')}) AS text_coverage, len(a) = 0 AND length({strip('text')}) > 500 AS is_annex_mode FROM heads)""",
    """flags AS (SELECT *, CASE WHEN is_annex_mode THEN CASE WHEN text_coverage < 0.9 THEN ['low_coverage'] ELSE [] END ELSE list_filter([CASE WHEN match_rate < 0.95 THEN 'low_match_rate' END, CASE WHEN len(missing) > 0 THEN 'processed_missing_articles' END, CASE WHEN len(extra) > 0 THEN 'processed_extra_articles' END], lambda x: x IS NOT NULL) END AS qa_flags FROM gate)""",
)
CLAUSES = (
    *CLEANED,
    segments("clseg", r"(?m)^\s*[①-⑳]", "cleaned", "body", "doc_id, number"),
    r"clauses AS (SELECT doc_id, number, i, regexp_extract(seg, '[①-⑳]', 0) AS clause_no, len(regexp_extract_all(seg, '(?m)^\s*\d{1,2}[.)]')) AS items FROM clseg WHERE i > 0)",
)
LINE_HEAD = r"^(?:###?\s*)?제\s*\d+조(?:의\s*\d+)?\s*\([^)]+\)|^###?\s*제\s*\d+조(?:의\s*\d+)?[^(]"


def paged(pattern: str) -> str:
    return f"array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT regexp_matches(trim(x), '{pattern}')), chr(10))"


PARTICLES = ("은", "는", "이", "가", "을", "를", "과", "와", "에", "에서", "에게", "로", "으로")
SPACING_RULES = (
    (r"제\s*(\d+)\s*조\s*의\s*(\d+)", r"제\1조의\2"), (r"제\s*(\d+)\s*조", r"제\1조"), (r"표\s*(\d+)", r"표\1"), (r"\[별표\s*(\d+)\]", r"[별표\1]"),
    (r"(\d+)\s*(만원|억원|천원|원)", r"\1\2"), (r"(\d+)\s*(명|개|건|회|년|월|일)", r"\1\2"), (r"(\d{4})\.\s*(\d{1,2})\.\s*(\d{1,2})", r"\1.\2.\3"),
    *[(rf"([가-힣]+)\s?{p}\s?([가-힣]+)", rf"\1{p} \2") for p in PARTICLES],
)


def rewritten(x: str, rules) -> str:
    for a, b in rules:
        x = f"regexp_replace({x}, '{a}', '{b}', 'g')"
    return x


CHUNKS = (
    *CLEANED,
    *AMENDMENTS,
    *ANNEX,
    """made AS (
      SELECT doc_id, 0 AS r, 0 AS o, 1 AS k, 'title' AS type, string_split(text, chr(10))[1] AS content, NULL AS article_number, NULL AS chapter_number FROM docs
      UNION ALL SELECT doc_id, 1, 0, 1, 'amendment_history', string_agg(kind || ' ' || amendment_date, chr(10) ORDER BY amendment_order), NULL, NULL FROM amend GROUP BY doc_id
      UNION ALL SELECT doc_id, 3, section_order, 1, 'article', number || '(' || title || ')' || chr(10) || clean_body, number, chapter_number FROM cleaned
      UNION ALL SELECT c.doc_id, 3, a.o, 0, 'chapter', c.number || ' ' || c.title, NULL, c.number FROM chap1 c JOIN (SELECT doc_id, chapter_number, min(section_order) AS o FROM cleaned GROUP BY ALL) a ON a.doc_id = c.doc_id AND a.chapter_number = c.number
      UNION ALL SELECT doc_id, 4, 0, 1, 'annex_whole', content, NULL, NULL FROM ann)""",
)
MARKDOWN = strip("regexp_replace(regexp_replace(translate(content, '─━│┃┌┐└┘├┤┬┴┼╋═║╔╗╚╝╠╣╦╩╬■□▪▫', ''), '[ \\t]+', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g')")
OLD, NEW = "number || '(' || title || ')' || chr(10) || body", "CASE doc_id % 4 WHEN 0 THEN replace(old, '승진', '이동') WHEN 1 THEN replace(old, '①', '') WHEN 2 THEN body ELSE old END"
TERMS = "['정직', '해임', '파면', '임용', '승진', '전보', '겸임', '휴직', '복직', '면직', '강등', '징계', '채용', '결격', '부칙', '개정', '시행', '제정']"
DOC_FEATURES = r"""length(text) AS char_count, len(string_split(text, chr(10) || chr(10))) AS pages, length(text)::DOUBLE / greatest(len(string_split(text, chr(10) || chr(10))), 1) AS text_per_page,
  regexp_matches(text, '제\s*\d+\s*조') AS has_articles, regexp_matches(text, '별표|별지') AS has_annex, regexp_matches(text, '별지\s*[제]?\s*\d+\s*호\s*서식') AS has_form,
  CASE WHEN text = '' THEN 0.0 ELSE length(regexp_replace(text[1:1000], '[^0-9]', '', 'g'))::DOUBLE / length(text[1:1000]) END AS digit_density,
  CASE WHEN len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) = 0 THEN 0.0 ELSE len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '' AND length(trim(x)) < 50))::DOUBLE / len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) END AS short_line_ratio"""
GOLDEN = r"regexp_replace(regexp_replace({}, '\s+', ' ', 'g'), '[^\p{{L}}\p{{N}}_\s(),.\-①-⑳]', '', 'g')"

LENGTH = "substring(x, a + 1, 512)"
#: Where a chunk by length ends that begins at ``a``: after the last mark inside it, of the first kind that it has.
END = f"CASE WHEN a + 512 >= n THEN n {' '.join(f"WHEN length(regexp_extract({LENGTH}, '(?s)^(.*){p}', 1)) > 0 THEN a + length(regexp_extract({LENGTH}, '(?s)^(.*){p}', 1)) + {k}" for p, k in ((r'\n\n', 2), (r'\n', 1), (r'\. ', 2), ('。', 1)))} ELSE a + 512 END"
PER_ARTICLE = r"per AS (SELECT c.doc_id, c.number, c.clean_body, count(l.clause_no) AS cl, coalesce(sum(l.items), 0) AS it, len(regexp_extract_all(c.body, '(?m)^\s*\d{1,2}[.)]')) AS nums, regexp_matches(c.body, '(?m)^제\d+조(?:의\d+)?\s*[\(\[]') OR regexp_matches(c.clean_body, '(?m)^제\s*\d+\s*장\s') AS bleeds FROM cleaned c LEFT JOIN clauses l ON l.doc_id = c.doc_id AND l.number = c.number GROUP BY c.doc_id, c.number, c.clean_body, c.body)"
LAYERS = "(1 + (sum(cl) > 0)::INT + (max((nums > 0 AND cl > 0)::INT) > 0 AND sum(it) > 0)::INT)::DOUBLE / (1 + (sum(cl) > 0)::INT + max((nums > 0 AND cl > 0)::INT))"


def prompted(version: str) -> str:
    """The prompt of a version for a page of ``docs``."""
    s = {k: "'" + v.replace("'", "''") + "'" for k, v in VERSIONS[version].items()}
    return f"""md5({s["task"]} || chr(10) || {s["must"]} || chr(10) || CASE WHEN contains(text, '제1조') THEN {s["statute"]} || chr(10) ELSE '' END
      || CASE WHEN regexp_matches(text, '개정|차|제정|시행') AND len(regexp_extract_all(text, '\\d{{4}}\\.\\d{{1,2}}\\.\\d{{1,2}}')) >= 3 THEN {s["tables"]} ELSE {s["no_tables"]} END)"""


#: The corpus has no loose header, that is none at the start of a line without a title, so none is looked for here.
STRICT_HEAD, CHAPTER_HEAD = r"[\s⟨<\[]*제\s*\d+(?:의\d+)?\s*조\s*\(", r"[\s⟨<\[]*제\s*\d+\s*장"
STARTS = "coalesce(sum(length(seg)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos"
PIECES = (
    r"lb AS (SELECT doc_id, regexp_replace(regexp_replace(text, ' {2,}', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g') AS text FROM docs)",
    segments("sg0", r"[\s⟨<\[]*기\s*본\s*정\s*신[\s⟩>\]]*", "lb"),
    segments("sg1", "(?m)^" + STRICT_HEAD, "lb"),
    segments("sg2", "(?m)^" + CHAPTER_HEAD, "lb"),
    rf"""bnd AS (SELECT doc_id, pos, 0 AS rank, 'basic' AS type, '기본정신' AS boundary, NULL AS title FROM (SELECT *, {STARTS} FROM sg0) WHERE i = 1
      UNION ALL SELECT doc_id, pos, 1, 'article', {strip(r"regexp_extract(seg, '제\s*\d+(?:의\d+)?\s*조', 0)")}, nullif(regexp_extract(substring(seg, 1, 50), '^[\s⟨<\[]*제\s*\d+(?:의\d+)?\s*조\s*\(([^)]+)\)', 1), '') FROM (SELECT *, {STARTS} FROM sg1) WHERE i > 0
      UNION ALL SELECT doc_id, pos, 3, 'chapter', {strip(r"regexp_extract(seg, '제\s*\d+\s*장', 0)")}, NULL FROM (SELECT *, {STARTS} FROM sg2) WHERE i > 0)""",
    "nxt AS (SELECT *, lead(pos) OVER (PARTITION BY doc_id ORDER BY pos, rank) AS upto FROM bnd)",
    f"whl AS (SELECT n.doc_id, n.pos, n.rank, n.type, n.boundary, n.title, {strip("substring(l.text, n.pos::BIGINT + 1, coalesce(n.upto, length(l.text))::BIGINT - n.pos::BIGINT)")} AS content FROM nxt n JOIN lb l ON l.doc_id = n.doc_id)",
    "pcs AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos, rank) AS chunk_index FROM whl WHERE length(content) >= 100)",
)
#: The annexes of the corpus are short enough to be one block each, which its text makes a table; the walk over longer ones has tests of its own.
ANNEX_BLOCKS = (
    *FEATURES,
    r"blk AS (SELECT b.*, f.digit_density, f.short_line_ratio, f.header_hint, 0.4 * digit_density + 0.3 * short_line_ratio + CASE WHEN header_hint THEN 0.1 ELSE 0.0 END - CASE WHEN short_line_ratio < 0.3 THEN 0.05 ELSE 0.0 END AS score FROM body b JOIN feat f ON f.doc_id = b.doc_id AND f.annex_index = b.annex_index)",
    rf"""knd AS (SELECT *, CASE WHEN score >= 0.55 OR len(list_filter(bl[1:5], lambda x: len(list_filter({HINTS}, lambda w: contains(replace(x, ' ', ''), w))) > 0)) > 0
      AND (len(list_filter(bl, lambda x: regexp_matches(x, '^\s*\d+\.\s+'))) >= 2 OR score >= 0.45 OR len(list_filter(bl, lambda x: regexp_matches(trim(x), '^[1-9]급'))) > 0) THEN 'table_rows' ELSE 'paragraph' END AS kind FROM blk)""",
)
ANNEX_CHUNKS = (
    *ANNEX_BLOCKS,
    r"""plc AS (SELECT *, list_filter(range(len(bl)), lambda i: regexp_matches(replace(bl[i + 1], ' ', ''), '임용하고자|서열명부|직급|응시자격')) AS hd, list_filter(range(len(bl)), lambda i: regexp_matches(bl[i + 1], '^\*?\s*(비고|주|註|note|임용하고자)')) AS nt FROM knd)""",
    "cts AS (SELECT *, CASE WHEN kind = 'table_rows' THEN list_sort(list_distinct(list_filter(list_concat(hd[2:], list_transform(nt, lambda i: i + 1)), lambda i: i > 0 AND i < len(bl)))) ELSE [] END AS c FROM plc)",
    "prt AS (SELECT doc_id, annex_index, annex_no, header, kind, k, k = len(c) AS last, bl[coalesce(c[k], 0) + 1 : coalesce(c[k + 1], len(bl))] AS ls FROM (SELECT *, unnest(range(len(c) + 1)) AS k FROM cts))",
    r"nts AS (SELECT *, CASE WHEN last THEN list_filter(range(len(ls)), lambda i: regexp_matches(trim(ls[i + 1]), '^\*\s*(.+)$'))[1] END AS nix FROM prt)",
    f"""pcsx AS (
      SELECT DISTINCT doc_id, annex_index, annex_no, -1 AS k, 0 AS h, 'header' AS section_type, header AS content FROM nts
      UNION ALL SELECT doc_id, annex_index, annex_no, k, 0, kind, {strip("array_to_string(CASE WHEN nix IS NULL THEN ls ELSE ls[1:nix] END, chr(10))")} FROM nts
      UNION ALL SELECT doc_id, annex_index, annex_no, k, 1, 'note', {strip("array_to_string(ls[nix + 1:], chr(10))")} FROM nts WHERE nix IS NOT NULL)""",
    "achk AS (SELECT doc_id, annex_index, annex_no, row_number() OVER (PARTITION BY doc_id, annex_index ORDER BY k, h) - 1 AS chunk_order, section_type, content, length(content) AS char_count FROM pcsx WHERE content <> '')",
)
ANNEX_LOSS = (
    *ANNEX_CHUNKS,
    "los AS (SELECT c.doc_id, length(c.t) AS total_chars, coalesce(sum(a.char_count), 0) AS kept_chars, count(a.content) AS chunk_count, coalesce(bool_or(a.section_type = 'header'), false) AS has_header, coalesce(bool_or(a.section_type <> 'header'), false) AS has_content FROM canon c LEFT JOIN achk a ON a.doc_id = c.doc_id GROUP BY c.doc_id, c.t)",
    "vld AS (SELECT *, CASE WHEN total_chars = 0 THEN 0.0 ELSE greatest(total_chars - kept_chars, 0)::DOUBLE / total_chars END <= 0.03 AS is_valid FROM los)",
    """afb AS (SELECT a.doc_id, row_number() OVER (PARTITION BY a.doc_id ORDER BY annex_index, chunk_order) AS annex_order, section_type, content, false AS is_fallback FROM achk a JOIN vld v ON v.doc_id = a.doc_id AND v.is_valid
      UNION ALL SELECT n.doc_id, 1, 'whole', n.content, true FROM ann n JOIN vld v ON v.doc_id = n.doc_id AND NOT v.is_valid)""",
)
REGROUPED = (
    *ANNEX_CHUNKS,
    "own AS (SELECT *, CASE WHEN contains(regexp_replace(content, '[ \n]', '', 'g'), '3급승진제외') THEN '3급승진제외' WHEN contains(regexp_replace(content, '[ \n]', '', 'g'), '3급승진') AND NOT contains(regexp_replace(content, '[ \n]', '', 'g'), '제외') THEN '3급승진' WHEN char_count < 50 THEN '?' END AS label FROM achk WHERE section_type = 'table_rows')",
    """spr AS (SELECT *, CASE WHEN label = '?' THEN coalesce(last_value(nullif(label, '?') IGNORE NULLS) OVER (PARTITION BY doc_id, annex_index ORDER BY chunk_order ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
      first_value(nullif(label, '?') IGNORE NULLS) OVER (PARTITION BY doc_id, annex_index ORDER BY chunk_order ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)) ELSE label END AS table_label FROM own)""",
)
RULE = "repeat('=', 60)"
SUMMARY = f"""concat_ws(chr(10), {RULE}, '문서명: ' || title, {RULE}, '', '[처리 결과]', '- PDF 텍스트: ' || format('{{:,}}', source_chars) || '자', '- 처리 텍스트: ' || format('{{:,}}', processed_chars) || '자',
  '- 총 장: ' || chapters || '개', '- 총 조문: ' || articles || '개', '- 개정이력: ' || amendments || '건', '- 청크: ' || chunks || '개', '', '[QA 결과]',
  '- 조문 헤더 매칭률: ' || CAST(round(match_rate * 100) AS INT) || '% (' || (len(a) - len(missing)) || '/' || len(a) || ')', '- 이상 징후: ' || CASE WHEN len(qa_flags) = 0 THEN '없음' ELSE array_to_string(qa_flags, ', ') END,
  '- 판정: ' || CASE WHEN CASE WHEN is_annex_mode THEN text_coverage >= 0.9 ELSE match_rate >= 0.95 AND len(qa_flags) = 0 END THEN '✅ PASS' ELSE '⚠️ WARNING' END)"""

#: Two versions of each document, their articles paired rule by rule (places that pairs have in both), and the longest rising run of each document, found from its last element on.
PAIR_RULES = ("number, text", "text", "number, title", "title", "number")
VERSIONS_OF = (
    *ATTACHED,
    """nowv AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN section_order + 1 WHEN doc_id % 6 = 2 AND section_order = 0 THEN 1000 ELSE section_order END AS pos,
      CASE WHEN doc_id % 3 = 0 THEN '제' || (regexp_extract(number, '\\d+')::INT + 1) || '조' ELSE number END AS number, CASE WHEN doc_id % 15 = 10 AND section_order = 0 THEN 'x' ELSE title END AS title,
      CASE WHEN doc_id % 3 = 1 AND section_order % 2 = 1 THEN body || ' x1' ELSE body END AS body FROM arts WHERE NOT (doc_id % 3 = 2 AND section_order = 1)
      UNION ALL SELECT doc_id, 0, '제1조', '신설', '새 조문 ' || doc_id FROM arts WHERE doc_id % 3 = 0 AND section_order = 0)""",
    f"g0 AS (SELECT doc_id, section_order AS pos, number, title, {strip(GOLDEN.format('body'))} AS text FROM arts)",
    f"c0 AS (SELECT doc_id, pos, number, title, {strip(GOLDEN.format('body'))} AS text FROM nowv)",
    *[
        step
        for k, rule in enumerate(PAIR_RULES)
        for step in (
            f"m{k} AS (SELECT g.doc_id, g.pos AS ga, c.pos AS ca FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, {rule} ORDER BY pos) AS nth FROM g{k}) g JOIN (SELECT *, row_number() OVER (PARTITION BY doc_id, {rule} ORDER BY pos) AS nth FROM c{k}) c USING (doc_id, {rule}, nth))",
            f"g{k + 1} AS (SELECT * FROM g{k} g WHERE NOT EXISTS (SELECT 1 FROM m{k} m WHERE m.doc_id = g.doc_id AND m.ga = g.pos))",
            f"c{k + 1} AS (SELECT * FROM c{k} c WHERE NOT EXISTS (SELECT 1 FROM m{k} m WHERE m.doc_id = c.doc_id AND m.ca = c.pos))",
        )
    ],
    f"pairs AS MATERIALIZED ({' UNION ALL '.join(f'SELECT * FROM m{k}' for k in range(len(PAIR_RULES)))})",
    "chain AS (SELECT doc_id, ga, ca, 1 AS n FROM pairs UNION SELECT p.doc_id, p.ga, p.ca, h.n + 1 FROM chain h JOIN pairs p ON p.doc_id = h.doc_id AND p.ga > h.ga AND p.ca > h.ca)",
    "longest AS MATERIALIZED (SELECT doc_id, ga, ca, max(n) AS n FROM chain GROUP BY ALL)",
    "back AS (SELECT doc_id, max(ga) AS ga, arg_max(ca, ga) AS ca, n FROM longest WHERE (doc_id, n) IN (SELECT doc_id, max(n) FROM longest GROUP BY doc_id) GROUP BY doc_id, n UNION ALL SELECT doc_id, ga, ca, n FROM (SELECT l.*, row_number() OVER (PARTITION BY l.doc_id ORDER BY l.ga DESC) AS r FROM back b JOIN longest l ON l.doc_id = b.doc_id AND l.n = b.n - 1 AND l.ga < b.ga AND l.ca < b.ca) WHERE r = 1)",
    """told AS (SELECT coalesce(g.doc_id, c.doc_id) AS doc_id, g.number AS number_then, c.number AS number_now, g.title AS title_then, c.title AS title_now, g.pos AS at_then, c.pos AS at_now, b.n IS NOT NULL AS in_place,
      CASE WHEN g.pos IS NULL OR c.pos IS NULL THEN 0.0 WHEN g.text = c.text THEN 1.0 ELSE 1 - levenshtein(g.text, c.text)::DOUBLE / greatest(length(g.text), length(c.text)) END AS similarity,
      CASE WHEN c.pos IS NULL THEN 'missing' WHEN g.pos IS NULL THEN 'added' WHEN g.text = c.text AND g.title = c.title AND g.number = c.number THEN 'same'
        ELSE concat_ws('+', CASE WHEN g.text <> c.text THEN 'body' END, CASE WHEN g.title <> c.title THEN 'title' END, CASE WHEN g.number <> c.number THEN 'number' END) END AS status
      FROM g0 g LEFT JOIN pairs p ON p.doc_id = g.doc_id AND p.ga = g.pos FULL JOIN c0 c ON c.doc_id = p.doc_id AND c.pos = p.ca LEFT JOIN back b ON b.doc_id = g.doc_id AND b.ga = g.pos)""",
)


SQL = {
    "article_count_by_chapter": cte(*ATTACHED) + "SELECT doc_id, chapter, count(*) AS articles FROM arts GROUP BY ALL",
    "articles": cte(*ATTACHED) + r"SELECT doc_id, CAST(section_order AS BIGINT) AS section_order, number AS article_number, title AS article_title, chapter, body, array_to_string(list_sort(list_distinct(regexp_extract_all(body, '\[[^\n]*?(\d{4}\.\d{2}\.\d{2})[^\n]*?\]', 1))), ',') AS amended_dates, regexp_matches(body, '<삭제\s*\d{4}\.\d{2}\.\d{2}>') AS is_deleted, CAST(start AS BIGINT) AS start_pos FROM arts",
    "chapters": cte(*CHAPTERS) + "SELECT doc_id, CAST(section_order AS BIGINT) AS section_order, number AS chapter_number, title AS chapter_title, CAST(start AS BIGINT) AS start_pos FROM chap1",
    "tree_nodes": cte(*CLAUSES) + "SELECT c.doc_id, c.number AS article_number, coalesce(string_agg(l.clause_no || l.items, ',' ORDER BY l.i), '') AS clauses FROM cleaned c LEFT JOIN clauses l ON l.doc_id = c.doc_id AND l.number = c.number GROUP BY c.doc_id, c.number",
    "parsed_totals": cte(*ATTACHED) + r"SELECT d.doc_id, CASE WHEN regexp_matches(text, '제\d+조') THEN 'legal' WHEN contains(text, '[별표') THEN 'annex_only' ELSE 'unknown' END AS document_kind, (SELECT count(*) FROM chap1 c WHERE c.doc_id = d.doc_id) * regexp_matches(text, '제\d+조')::INT AS total_chapters, (SELECT count(*) FROM arts a WHERE a.doc_id = d.doc_id) AS total_articles FROM docs d",
    "amendment_history": cte(*AMENDMENTS) + "SELECT doc_id, CAST(amendment_order AS BIGINT) AS amendment_order, kind, amendment_date FROM amend",
    "annex_header": cte(*ANNEX) + rf"SELECT doc_id, regexp_extract(content, '\[별표\s*(\d+)\]', 1) AS annex_no, {strip(r"regexp_extract(content, '\[별표\s*\d+\]\s*([^\n<]+)', 1)")} AS annex_title, {strip(r"regexp_extract(content, '<(제\d+조[^>]*)관련>', 1)")} AS related_article, CAST(length(content) AS BIGINT) AS annex_chars FROM ann",
    "annex_sections": cte(*SECTIONS) + "SELECT doc_id, CAST(annex_index AS BIGINT) AS annex_index, annex_no, annex_title, header, related_article, md5(array_to_string(bl, chr(10))) AS body_md5 FROM body",
    "clean_page_artifacts": cte() + f"SELECT doc_id, md5(regexp_replace({paged(r'^[가-힣]{2,10}\s*\d{1,5}-\d{1,3}\s*$')}, '\\n{{3,}}', chr(10) || chr(10), 'g')) AS text_md5 FROM docs",
    "clean_page_dividers": cte() + f"SELECT doc_id, md5({paged(r'^(?:(?i:Page\s+\d+)|[-—–_]{3,})\s*$')}) AS text_md5, CAST(len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(trim(x), '^(?:(?i:Page\\s+\\d+)|[-—–_]{{3,}})\\s*$'))) AS BIGINT) AS removed FROM docs",
    "clean_article_body": cte(*CLEANED) + "SELECT doc_id, number AS article_number, clean_body FROM cleaned",
    "clean_annex_markdown": cte(*ANNEX) + f"SELECT doc_id, md5({MARKDOWN}) AS text_md5 FROM ann",
    "clean_annex_canonical": cte(*SECTIONS) + "SELECT doc_id, md5(t) AS text_md5 FROM canon",
    "law_spacing": cte() + f"SELECT doc_id, md5({rewritten('text', SPACING_RULES)}) AS text_md5 FROM docs",
    "post_merge_normalize": cte() + rf"""SELECT doc_id, {strip(rewritten("('```md' || chr(10) || text || chr(10) || '```' || chr(10) || '- 3 -' || chr(10) || 'Page 1 / 3')", ((r"```[a-zA-Z0-9_-]*\s*", ""), (r"\s*```", ""), (r"\b\d{3,4}\s*-\s*\d{1,2}\b", ""), (r"(?i)Page\s+\d+\s*/\s*\d+", ""), (r"(?m)^\s*-\s*\d+\s*-\s*$", ""), (r"\s{2,}", " "))))} AS text FROM docs""",
    "line_break_cleanup": rf"SELECT doc_id, md5(regexp_replace(regexp_replace(text, ' {{2,}}', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')) AS text_md5, {strip(r"regexp_replace(text, '\s+', ' ', 'g')")}[1:500] AS head FROM documents",
    "golden_normalize_md5": f"SELECT doc_id, md5({strip(GOLDEN.format('text'))}) AS checksum FROM documents",
    "article_number_repair": cte() + r"""SELECT doc_id, CASE WHEN f IS NULL THEN t ELSE CASE WHEN doc_id > 200 THEN replace(replace(t, '제402조', f), '제' || doc_id || '조의2', f) ELSE replace(t, '제402조', f) END END AS text, '402-' || doc_id % 90 AS page_numbers FROM (
      SELECT doc_id, '제402조 및 제' || doc_id || '조의2 402-' || doc_id % 90 AS t, list_filter(list_transform(regexp_extract_all(text, '제\s?(\d+)조', 1), lambda x: CASE WHEN CAST(x AS BIGINT) <= 200 THEN '제' || x || '조' END), lambda x: x IS NOT NULL)[1] AS f FROM docs)""",
    "doc_features": f"SELECT doc_id, CAST(char_count AS BIGINT) AS char_count, CAST(pages AS BIGINT) AS pages, round(text_per_page, 6) AS text_per_page, has_articles, round(digit_density, 6) AS digit_density, round(short_line_ratio, 6) AS short_line_ratio FROM (SELECT doc_id, {DOC_FEATURES} FROM documents)",
    "doc_type": cte() + f"""SELECT doc_id, doc_type, CASE doc_type WHEN 'form' THEN 0.9 WHEN 'law_annex' THEN 0.9 WHEN 'image_heavy' THEN 0.8 WHEN 'stats_chart' THEN 0.7 ELSE 0.5 END::DOUBLE AS confidence, CASE WHEN doc_type IN ('law_annex', 'form') THEN 'LawMode' ELSE 'VLM' END AS mode FROM (
      SELECT doc_id, CASE WHEN has_form AND has_annex THEN 'form' WHEN has_articles AND has_annex THEN 'law_annex' WHEN text_per_page < 300 THEN 'image_heavy' WHEN round(digit_density, 3) >= 0.1 THEN 'stats_chart' ELSE 'general' END AS doc_type FROM (
        SELECT doc_id, {DOC_FEATURES} FROM (SELECT doc_id, text FROM docs UNION ALL SELECT -doc_id - 1, text FROM documents)))""",
    "doc_profile": cte() + r"""SELECT doc_id, profile, route, CASE profile WHEN 'law_hr' THEN 'law_kor_hr_v1' WHEN 'law_generic' THEN 'law_kor_generic_v1' WHEN 'law_terms' THEN 'law_kor_terms_v1' ELSE 'vlm_general_v1' END AS profile_id, CASE profile WHEN 'vlm_general' THEN 'vlm' ELSE 'law' END AS profile_mode, CASE profile WHEN 'law_terms' THEN 0.9 WHEN 'vlm_general' THEN 0.8 ELSE 0.95 END::DOUBLE AS least_match FROM (
      SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'law_hr' WHEN doc_id % 5 = 1 THEN 'law_terms' WHEN contains(text, '기본정신') THEN 'law_hr' WHEN len(regexp_extract_all(text, '제\d+조')) > 5 THEN 'law_generic' ELSE 'vlm_general' END AS profile,
        CASE WHEN regexp_matches(text, '제\d+조') THEN 'legal' WHEN contains(text, '[별표') THEN 'annex_only' ELSE 'unknown' END AS route FROM docs)""",
    "text_ratios": cte() + r"""SELECT doc_id, round(least(1.0, (len(regexp_extract_all(text, '제\s?\d+조')) + len(regexp_extract_all(text, '제\s?\d+항')) + len(regexp_extract_all(text, '제\s?\d+호')) + len(regexp_extract_all(text, '\(\d+\)')) + len(regexp_extract_all(text, '[①-⑩]')) + len(regexp_extract_all(text, '(?m)^\d+\.')))::DOUBLE / len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> ''))), 6) AS token_ratio,
      round(len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '^\s*(?:\d+\.|\d+\)|[①-⑳]|\(\d+\))')))::DOUBLE / len(string_split(text, chr(10))), 6) AS numbered_density,
      regexp_matches(text, '개정|차|제정|시행') AND len(regexp_extract_all(text, '\d{4}\.\d{1,2}\.\d{1,2}')) >= 3 AS revision_page FROM docs""",
    "text_table_hints": cte(*SECTIONS) + rf"""SELECT doc_id, CAST(annex_index AS BIGINT) AS annex_index, len(k) > 0 AS has_header_hint, array_to_string(list_sort(k), ',') AS header_keywords, CAST(len(list_filter(bl, lambda x: regexp_matches(x, '^\s*\d+\.\s+'))) AS BIGINT) AS numbered_count, CAST(len(list_filter(bl, lambda x: regexp_matches(x, '^[1-9]급'))) AS BIGINT) AS rank_count FROM (
      SELECT doc_id, annex_index, bl, list_filter({HINTS}, lambda w: len(list_filter(bl[1:5], lambda x: contains(replace(x, ' ', ''), w))) > 0) AS k FROM body)""",
    "table_score": cte(*FEATURES) + "SELECT doc_id, CAST(annex_index AS BIGINT) AS annex_index, round(digit_density, 6) AS digit_density, round(short_line_ratio, 6) AS short_line_ratio, round(0.4 * digit_density + 0.3 * short_line_ratio + CASE WHEN header_hint THEN 0.1 ELSE 0.0 END - CASE WHEN short_line_ratio < 0.3 THEN 0.05 ELSE 0.0 END, 6) AS score FROM feat",
    "interval_merge": """WITH r AS (SELECT l_suppkey, CAST(date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) AS BIGINT) AS s, l_quantity, l_linenumber FROM lineitem), x AS (SELECT l_suppkey, s, CAST(s + l_linenumber AS BIGINT) AS e, l_quantity FROM r),
      y AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY l_suppkey ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS apart FROM x), z AS (SELECT *, sum(apart) OVER (PARTITION BY l_suppkey ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM y)
      SELECT l_suppkey, min(s) AS s, max(e) AS e, max(l_quantity) AS l_quantity, count(*) AS merged FROM z GROUP BY l_suppkey, run""",
    "label_propagation": """SELECT event_id, user_id, CASE WHEN open THEN coalesce(last_value(known IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), first_value(known IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), event_type) ELSE event_type END AS label FROM (
      SELECT event_id, user_id, event_type, event_type IN ('view', 'click') AS open, CASE WHEN event_type NOT IN ('view', 'click') THEN event_type END AS known FROM events)""",
    "annex_blocks": cte(*ANNEX_BLOCKS) + 'SELECT doc_id, CAST(annex_index AS BIGINT) AS annex_index, 0::BIGINT AS block_order, kind, 0::BIGINT AS start, CAST(len(bl) AS BIGINT) AS "end", round(score, 6) AS score FROM knd',
    "annex_chunks": cte(*ANNEX_CHUNKS) + "SELECT doc_id, CAST(annex_index AS BIGINT) AS annex_index, annex_no, chunk_order, section_type, content, CAST(char_count AS BIGINT) AS char_count FROM achk",
    "validate_subchunks": cte(*ANNEX_LOSS) + "SELECT doc_id, CAST(total_chars AS BIGINT) AS total_chars, CAST(kept_chars AS BIGINT) AS kept_chars, chunk_count, is_valid, has_header, has_content, CASE WHEN is_valid THEN 'ok' ELSE 'loss' END AS reason FROM vld",
    "annex_fallback_chunks": cte(*ANNEX_LOSS) + "SELECT doc_id, annex_order, section_type, content, is_fallback FROM afb",
    "logical_regroup": cte(*REGROUPED)
    + """SELECT doc_id, CAST(annex_index AS BIGINT) AS annex_index, annex_no, chunk_order, section_type, content, CAST(char_count AS BIGINT) AS char_count, NULL AS table_label, 1::BIGINT AS merged_count FROM achk WHERE section_type <> 'table_rows'
      UNION ALL SELECT doc_id, CAST(annex_index AS BIGINT), annex_no, min(chunk_order), 'table_rows', string_agg(content, chr(10) ORDER BY chunk_order), CAST(sum(char_count) AS BIGINT), any_value(table_label), count(*) FROM spr GROUP BY doc_id, annex_index, annex_no, coalesce(table_label, '#' || chunk_order)""",
    "chunks_with_tables": cte(
        *CHUNKS, *[x for x in ANNEX_LOSS if x not in CHUNKS],
        r"rwx AS (SELECT *, CASE WHEN section_type = 'table_rows' AND NOT is_fallback THEN regexp_extract_all(content, '(?m)^\d+\s+\d+번까지') ELSE [] END AS hits FROM afb)",
        r"""evr AS (SELECT doc_id, r, o, k, type, content, article_number, chapter_number FROM made WHERE type <> 'annex_whole'
          UNION ALL SELECT doc_id, 4, annex_order, 0, CASE WHEN is_fallback THEN 'annex' ELSE 'annex_' || section_type END, content, NULL, NULL FROM rwx WHERE len(hits) = 0
          UNION ALL SELECT doc_id, 4, annex_order, k, 'table_row', regexp_extract(hits[k], '^(\d+)', 1) || '명 → ' || regexp_extract(hits[k], '\s(\d+)번', 1) || '번까지', NULL, NULL FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS k FROM rwx))""",
    )
    + "SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY r, o, k) - 1 AS BIGINT) AS chunk_pos, type, content, article_number, chapter_number, CAST(length(content) AS BIGINT) AS char_count FROM evr",
    "annex_boundaries": cte(*SECTIONS) + r"""SELECT doc_id, CAST(annex_index AS BIGINT) AS annex_index, array_to_string(list_sort(list_distinct(list_filter(list_concat(hd[2:], list_transform(nt, lambda i: i + 1)), lambda i: i > 0 AND i < len(bl)))), ',') AS boundaries FROM (
      SELECT doc_id, annex_index, bl, list_filter(range(len(bl)), lambda i: regexp_matches(replace(bl[i + 1], ' ', ''), '임용하고자|서열명부|직급|응시자격')) AS hd, list_filter(range(len(bl)), lambda i: regexp_matches(bl[i + 1], '^\*?\s*(비고|주|註|note|임용하고자)')) AS nt FROM body)""",
    "loss_check": """SELECT doc_id, CAST(t AS BIGINT) AS total_chars, CAST(t - n + 1 AS BIGINT) AS kept_chars, CAST(n AS BIGINT) AS chunk_count, round(l, 6) AS loss_rate, l <= 0.03 AS is_valid FROM (
      SELECT doc_id, length(text) AS t, len(string_split(text, chr(10))) AS n, CASE WHEN length(text) = 0 THEN 0.0 ELSE (len(string_split(text, chr(10))) - 1)::DOUBLE / length(text) END AS l FROM documents)""",
    "table_rules": "SELECT '" + "annex_1_3급승진제외' AS table_id, CAST(n AS BIGINT) AS n, CAST(CASE WHEN n <= 5 THEN 5 * n ELSE 25 + 3 * (n - 5) END AS BIGINT) AS rank FROM range(1, 76) t(n) UNION ALL SELECT 'annex_1_3급승진', n, 2 * n FROM range(1, 76) t(n)",
    "table_query": """SELECT n_nationkey, CASE WHEN n BETWEEN 1 AND 75 THEN CASE WHEN n_nationkey % 3 = 1 THEN '3급승진제외' ELSE '3급승진' END || '에서 ' || n || '명 임용 시 서열명부순위 ' || CASE WHEN n_nationkey % 3 <> 1 THEN 2 * n WHEN n <= 5 THEN 5 * n ELSE 25 + 3 * (n - 5) END || '번까지' END AS answer FROM (SELECT n_nationkey, n_nationkey * 4 AS n FROM nation)""",
    "table_rows_extract": cte(*ANNEX) + r"SELECT doc_id, CAST(regexp_extract(m, '^(\d+)\s+(\d+)', 1) AS BIGINT) AS n, CAST(regexp_extract(m, '^(\d+)\s+(\d+)', 2) AS BIGINT) AS rank FROM (SELECT doc_id, unnest(regexp_extract_all(content, '(?m)^(\d+)\s+(\d+)번까지')) AS m FROM ann)",
    "table_completion": cte(*ANNEX) + "SELECT doc_id, t.table_id, true AS is_generated, 75::BIGINT AS n_rows, t.ranks FROM ann, (VALUES ('annex_1_3급승진제외', (SELECT CAST(sum(CASE WHEN n <= 5 THEN 5 * n ELSE 25 + 3 * (n - 5) END) AS BIGINT) FROM range(1, 76) t(n))), ('annex_1_3급승진', (SELECT CAST(sum(2 * n) AS BIGINT) FROM range(1, 76) t(n)))) t(table_id, ranks)",
    "semantic_headers": cte() + r"""SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '(?m)^[\s⟨<\[]*(제\s*\d+(?:의\d+)?\s*조)(?:\s*\(|\s|$)', 1))), ',') AS headers FROM docs""",
    "chapter_lines": cte(segments("lseg", r"(?m)^[\s⟨<\[]*제\s*\d+\s*장", "docs")) + r"SELECT doc_id, CAST(start AS BIGINT) AS pos, regexp_extract(seg, '제\s*\d+\s*장', 0) AS matched FROM (SELECT doc_id, i, seg, coalesce(sum(length(seg)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM lseg) WHERE i > 0",
    "fragment_merge": """WITH r AS (SELECT conv_id, turn, coalesce(text, '') AS content, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(text, '')) AS n FROM conversations), x AS (SELECT *, sum(CASE WHEN length(content) >= 200 OR n = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY n) AS run FROM r)
      SELECT conv_id, arg_min(turn, n) AS turn, md5(string_agg(content, chr(10) || chr(10) ORDER BY n)) AS content_md5, CAST(length(string_agg(content, chr(10) || chr(10) ORDER BY n)) AS BIGINT) AS char_count FROM x GROUP BY conv_id, run""",
    "semantic_chunks": cte(*PIECES) + "SELECT doc_id, chunk_index, type, boundary, title, CAST(pos AS BIGINT) AS pos, md5(content) AS content_md5, CAST(length(content) AS BIGINT) AS char_count FROM pcs",
    "loose_ratio": cte(*PIECES) + "SELECT DISTINCT doc_id, 0.0::DOUBLE AS loose_ratio, false AS loose_ratio_high FROM pcs",
    "semantic_with_fallback": cte(
        *PIECES,
        "frs AS (SELECT *, sum(CASE WHEN length(content) >= 200 OR chunk_index = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY chunk_index) AS run FROM pcs)",
        "rst AS (SELECT doc_id, text AS x, length(text) AS n FROM lb WHERE doc_id NOT IN (SELECT doc_id FROM pcs))",
        f"wlk AS (SELECT doc_id, a, {END} AS e FROM (SELECT doc_id, x, n, 0 AS a FROM rst WHERE n > 0) UNION ALL SELECT doc_id, a, {END} AS e FROM (SELECT t.doc_id, t.x, t.n, w.e AS a FROM wlk w JOIN rst t ON t.doc_id = w.doc_id WHERE w.e < t.n))",
        f"cut AS (SELECT w.doc_id, a, {strip("substring(x, a + 1, e - a)")} AS content FROM wlk w JOIN rst t ON t.doc_id = w.doc_id)",
    ).replace("WITH ", "WITH RECURSIVE ", 1)
    + """SELECT doc_id, min(chunk_index) AS chunk_index, arg_min(type, chunk_index) AS type, arg_min(boundary, chunk_index) AS boundary, max(title) FILTER (chunk_index = first) AS title, CAST(min(pos) AS BIGINT) AS pos, md5(string_agg(content, chr(10) || chr(10) ORDER BY chunk_index)) AS content_md5, CAST(length(string_agg(content, chr(10) || chr(10) ORDER BY chunk_index)) AS BIGINT) AS char_count FROM (SELECT *, min(chunk_index) OVER (PARTITION BY doc_id, run) AS first FROM frs) GROUP BY doc_id, run
      UNION ALL SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY a), 'fallback', 'length-based', NULL, NULL, md5(content), CAST(length(content) AS BIGINT) FROM cut WHERE length(content) >= 100""",
    "line_chunks": cte(rf"""ln AS (SELECT doc_id, unnest(range(len(l))) AS p, unnest(l) AS l FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM docs))""", rf"""mk AS (SELECT *, contains(l, '기본정신') OR contains(l, '개정이력') AS s, regexp_matches(trim(l), '{LINE_HEAD}') AS h FROM ln)""", "rn AS (SELECT *, sum(CASE WHEN s OR h OR p = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM mk)")
    + rf"""SELECT doc_id, CAST(run AS BIGINT) AS chunk_index, CASE WHEN arg_min(s, p) THEN '기본정신' END AS section_type, CASE WHEN NOT arg_min(s, p) AND arg_min(h, p) THEN regexp_extract(arg_min(l, p), '제\d+조', 0) END AS article_no, CASE WHEN NOT arg_min(s, p) AND arg_min(h, p) THEN regexp_extract(arg_min(l, p), '\(([^)]+)\)', 1) END AS article_title, {strip("string_agg(l, chr(10) ORDER BY p)")} AS content FROM rn GROUP BY doc_id, run""",
    "chunks": cte(*CHUNKS) + "SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY r, o, k) - 1 AS BIGINT) AS chunk_pos, type, content, article_number, chapter_number, CAST(length(content) AS BIGINT) AS char_count FROM made",
    "chunk_type_counts": cte(*CHUNKS) + "SELECT type, count(*) AS chunks FROM made GROUP BY type",
    "engine_md": cte(
        *CLEANED, *AMENDMENTS, *ANNEX,
        "chg AS (SELECT * FROM (SELECT doc_id, section_order, chapter_number, coalesce(lag(chapter_number) OVER (PARTITION BY doc_id ORDER BY section_order), '') AS b FROM cleaned) WHERE chapter_number <> '' AND chapter_number <> b)",
        f"""md AS (
          SELECT doc_id, 0 AS a, 0 AS b, '# ' || string_split(text, chr(10))[1] || chr(10) AS l FROM docs
          UNION ALL SELECT doc_id, 1, 0, '## 개정이력' || chr(10) || chr(10) || string_agg('- ' || kind || ' ' || amendment_date, chr(10) ORDER BY amendment_order) || chr(10) FROM amend GROUP BY doc_id
          UNION ALL SELECT h.doc_id, 2, 2 * h.section_order, '## ' || c.number || ' ' || c.title || chr(10) FROM chg h JOIN chap1 c ON c.doc_id = h.doc_id AND c.number = h.chapter_number
          UNION ALL SELECT doc_id, 2, 2 * section_order + 1, '### ' || number || '(' || title || ')' || chr(10) || chr(10) || clean_body || chr(10) FROM cleaned
          UNION ALL SELECT doc_id, 3, 0, '## 별표' || chr(10) || chr(10) || {MARKDOWN} || chr(10) FROM ann)""",
    )
    + "SELECT doc_id, md5(string_agg(l, chr(10) ORDER BY a, b)) AS text_md5, CAST(length(string_agg(l, chr(10) ORDER BY a, b)) AS BIGINT) AS chars FROM md GROUP BY doc_id",
    "dual_qa": cte(*GATE) + "SELECT doc_id, CAST(len(a) AS BIGINT) AS source_articles, array_to_string(missing, ',') AS missing, array_to_string(extra, ',') AS extra, round(match_rate, 6) AS match_rate, round(text_coverage, 6) AS text_coverage, array_to_string(qa_flags, ',') AS qa_flags, is_annex_mode, CASE WHEN is_annex_mode THEN text_coverage >= 0.9 ELSE match_rate >= 0.95 AND len(qa_flags) = 0 END AS is_pass FROM flags",
    "hierarchy_metrics": cte(*CLAUSES, PER_ARTICLE) + f"SELECT doc_id, count(*) AS articles, CAST(sum(cl) AS BIGINT) AS clauses, CAST(sum(it) AS BIGINT) AS items, round({LAYERS}, 6) AS hierarchy_preservation, round(avg((clean_body = '')::INT), 6) AS empty_article_rate, '' AS integrity_errors FROM per GROUP BY doc_id",
    "dod_pass_rate": cte(*CLAUSES, PER_ARTICLE, f"dod AS (SELECT {LAYERS} >= 0.95 AND avg(bleeds::INT) <= 0 AND avg((clean_body = '')::INT) <= 0 AS ok FROM per GROUP BY doc_id)") + "SELECT count(*) AS docs, CAST(sum(ok::INT) AS BIGINT) AS passed, avg(ok::INT) AS pass_rate FROM dod",
    "page_prompts": cte() + f"SELECT doc_id, {prompted('0.3')} AS prompt_md5, {prompted('0.4')} AS later_prompt_md5 FROM docs",
    "review_md": cte(
        *CHUNKS, *GATE,
        f"""told AS (SELECT f.*, string_split(p.text, chr(10))[1] AS title, length({strip('p.text')}) AS source_chars, length({strip('p.processed')}) AS processed_chars, (SELECT count(*) FROM chap1 x WHERE x.doc_id = f.doc_id) AS chapters,
          (SELECT count(*) FROM cleaned x WHERE x.doc_id = f.doc_id) AS articles, (SELECT count(*) FROM amend x WHERE x.doc_id = f.doc_id) AS amendments, (SELECT count(*) FROM made x WHERE x.doc_id = f.doc_id) AS chunks FROM flags f JOIN proc p ON p.doc_id = f.doc_id)""",
        f"""rv AS (
          SELECT doc_id, -2 AS r, 0 AS o, 0 AS k, '```' || chr(10) || {SUMMARY} || chr(10) || '```' || chr(10) || chr(10) || '---' || chr(10) AS l FROM told
          UNION ALL SELECT doc_id, -1, 0, 0, '# ' || title || chr(10) FROM told
          UNION ALL SELECT doc_id, r, o, k, CASE type WHEN 'chapter' THEN '## ' || content WHEN 'article' THEN '### ' || string_split(content, chr(10))[1] || chr(10) || content ELSE content END || chr(10) FROM made WHERE type <> 'title')""",
    )
    + "SELECT doc_id, md5(string_agg(l, chr(10) ORDER BY r, o, k)) AS text_md5, CAST(length(string_agg(l, chr(10) ORDER BY r, o, k)) AS BIGINT) AS chars FROM rv GROUP BY doc_id",
    "fallback_chunks": f"""WITH RECURSIVE t AS (SELECT doc_id, coalesce(text, '') AS x, length(coalesce(text, '')) AS n FROM documents), w AS (
        SELECT doc_id, a, {END} AS e FROM (SELECT doc_id, x, n, 0 AS a FROM t WHERE n > 0)
        UNION ALL SELECT doc_id, a, {END} AS e FROM (SELECT t.doc_id, t.x, t.n, w.e AS a FROM w JOIN t ON t.doc_id = w.doc_id WHERE w.e < t.n)),
      c AS (SELECT w.doc_id, a, {strip("substring(x, a + 1, e - a)")} AS content FROM w JOIN t ON t.doc_id = w.doc_id)
      SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY a) AS chunk_index, md5(content) AS content_md5, CAST(length(content) AS BIGINT) AS char_count FROM c WHERE length(content) >= 100""",
    "type_reason": f"""WITH d AS (SELECT doc_id, (doc_id % 10) / 10 AS score, CASE WHEN doc_id % 4 = 0 THEN repeat('7', 150) || text ELSE text END AS text FROM documents), f AS (SELECT doc_id, score, {DOC_FEATURES} FROM d)
      SELECT doc_id, coalesce(nullif(concat_ws(' OR ', CASE WHEN round(digit_density, 3) >= 0.1 THEN format('숫자 밀도 {{:.1f}}%', 100 * digit_density) END, CASE WHEN score >= 0.5 AND round(short_line_ratio, 2) >= 0.7 THEN format('표 구조 (score={{:.2f}}, short_line={{:.0f}}%)', score, 100 * short_line_ratio) END), ''), '기준 미달') AS stats_reason FROM f""",
    "bus_keywords": "SELECT doc_id, array_to_string(list_filter(['노선', '배차', '정류장', '첫차', '막차', '차고지', '버스'], lambda w: contains(t, w)), ',') AS words FROM (SELECT doc_id, text || CASE WHEN doc_id % 3 = 0 THEN ' 막차와 첫차의 배차' ELSE '' END || CASE WHEN doc_id % 5 = 0 THEN ' 버스 정류장' ELSE '' END AS t FROM documents)",
    "table_stats": cte(*ANNEX) + "SELECT unnest(['annex_1_3급승진', 'annex_1_3급승진제외']) AS table_id, count(*) AS documents, 75 * count(*) AS rows FROM ann",
    "golden_records": cte(
        *CLEANED, *AMENDMENTS,
        "ful AS (SELECT d.doc_id, string_split(any_value(d.text), chr(10))[1] || coalesce(string_agg(a.number || '(' || a.title || ')' || chr(10) || a.clean_body || chr(10), '' ORDER BY a.section_order), '') AS t, count(a.number) AS n, coalesce(string_agg(a.number || '(' || a.title || ')', '|' ORDER BY a.section_order), '') AS heads FROM docs d LEFT JOIN cleaned a ON a.doc_id = d.doc_id GROUP BY d.doc_id)",
        "chs AS (SELECT doc_id, count(*) AS n, string_agg(number || ' ' || title, '|' ORDER BY section_order) AS heads FROM chap1 GROUP BY doc_id)",
    )
    + f"SELECT f.doc_id, coalesce(c.n, 0) AS total_chapters, f.n AS total_articles, (SELECT count(*) FROM amend x WHERE x.doc_id = f.doc_id) AS amendments, coalesce(c.heads, '') AS chapter_headers, md5(f.heads) AS article_headers_md5, md5({strip(GOLDEN.format('t'))}) AS checksum, CAST(length(t) AS BIGINT) AS total_char_count FROM ful f LEFT JOIN chs c ON c.doc_id = f.doc_id",
    "benchmark_averages": "SELECT count(*) AS total_documents, round(avg(l_tax), 3) AS parse_sec, round(avg(l_discount), 3) AS golden_create_sec, round(avg(l_linenumber / 100), 3) AS golden_compare_sec, round(avg(l_quantity / 10), 3) AS total_sec, round(avg(l_quantity), 2) AS memory_mb, avg(l_tax) < 5 AND avg(l_discount) < 2 AND avg(l_linenumber / 100) < 1 AND avg(l_quantity / 10) < 10 AND avg(l_quantity) < 500 AS all_pass FROM lineitem",
    "rewrite_cache": cte(*CLEANED) + "SELECT count(*) AS total_cached, CAST(sum(strlen(t)) AS BIGINT) AS cache_size_bytes FROM (SELECT doc_id, number, min(clean_body) AS t FROM cleaned GROUP BY ALL)",
    "kvs_normalize": r"""WITH v AS (SELECT o_custkey, o_orderstatus AS key, o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN CASE WHEN floor(o_totalprice) >= 1000 THEN format('{:,}', CAST(floor(o_totalprice) AS BIGINT)) ELSE CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) END || '원' WHEN 1 THEN lpad(CAST(o_orderkey % 24 AS VARCHAR), 2, '0') || ':05' WHEN 2 THEN (o_orderkey % 60) || '분' END AS value FROM orders)
      SELECT o_custkey, key, value FROM v WHERE value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY o_custkey, key ORDER BY length(value) DESC, o_orderkey) = 1""",
    "golden_structure": cte(*ATTACHED) + "SELECT doc_id, number AS article_number, chapter_number, contains(body, '①') OR contains(body, '1.') AS has_clauses, CAST(len(list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '^\\s*(?:[①-③]|[1-3]\\.)'))) AS BIGINT) AS clause_count, CAST(length(body) AS BIGINT) AS content_length FROM arts",
    "golden_chapters": cte(*ATTACHED) + "SELECT c.doc_id, c.number AS chapter_number, c.title AS chapter_title, (SELECT count(*) FROM arts a WHERE a.doc_id = c.doc_id AND a.chapter_number = c.number) AS article_count FROM chap1 c",
    "golden_content": cte(*ATTACHED, "ful AS (SELECT d.doc_id, string_split(any_value(d.text), chr(10))[1] || coalesce(string_agg(a.number || '(' || a.title || ')' || chr(10) || a.body || chr(10), '' ORDER BY a.section_order), '') AS t FROM docs d LEFT JOIN arts a ON a.doc_id = d.doc_id GROUP BY d.doc_id)")
    + f"SELECT doc_id, CAST(length(t) AS BIGINT) AS total_char_count, md5({strip(GOLDEN.format('t'))}) AS checksum FROM ful",
    "golden_diff": cte(*ATTACHED, "cur AS (SELECT doc_id, number, section_order, CASE WHEN doc_id % 5 = 0 AND section_order = 0 THEN 'x' ELSE title END AS title FROM arts WHERE NOT (doc_id % 3 = 0 AND number = '제2조'))", "bth AS (SELECT a.doc_id, c.number IS NULL AS gone, coalesce(a.title = c.title, false) AS t FROM arts a LEFT JOIN cur c ON c.doc_id = a.doc_id AND c.number = a.number)")
    + "SELECT doc_id, count(*) AS articles, CAST(sum(gone::INT) AS BIGINT) AS missing, 0::BIGINT AS added, round(1 - avg(gone::INT), 6) AS structure_score, round(avg(t::INT), 6) AS header_score, round(1 - avg(gone::INT), 6) AS content_score, sum(gone::INT) = 0 AND avg(t::INT) >= 0.95 AS overall_pass FROM bth GROUP BY doc_id",
    "golden_alignment": cte(*VERSIONS_OF).replace("WITH ", "WITH RECURSIVE ", 1) + "SELECT doc_id, number_then, number_now, at_then, at_now, status, in_place, round(similarity, 6) AS similarity FROM told",
    "golden_report": cte(*VERSIONS_OF, "s AS (SELECT doc_id, count(*) AS articles, count(*) FILTER (status = 'missing') AS missing, count(*) FILTER (status = 'added') AS added, count(*) FILTER (number_then IS NOT NULL AND number_now IS NOT NULL AND NOT in_place) AS moved, count(*) FILTER (number_then <> number_now) AS renumbered, count(*) FILTER (title_then <> title_now) AS retitled, count(*) FILTER (number_then IS NOT NULL AND number_now IS NOT NULL AND similarity < 1) AS edited, avg(in_place::INT) AS st, count(*) FILTER (number_then = number_now AND title_then = title_now)::DOUBLE / count(*) AS he, avg(similarity) AS co FROM told GROUP BY doc_id)").replace("WITH ", "WITH RECURSIVE ", 1)
    + "SELECT doc_id, articles, missing, added, moved, renumbered, retitled, edited, round(st, 6) AS structure_score, round(he, 6) AS header_score, round(co, 6) AS content_score, round((st + he + co) / 3, 6) AS overall_score, st >= 1 AND he >= 0.95 AND co >= 0.9 AS overall_pass FROM s",
    "rewrite_sanity": cte(*ATTACHED, f"o AS (SELECT *, {OLD} AS old FROM arts)", f"n AS (SELECT *, {NEW} AS new FROM o)", rf"""k AS (SELECT doc_id, number, contains(new, number || '(' || title || ')') AS h, list_sort(list_distinct(regexp_extract_all(old, '\d+(?:\.\d+)?'))) = list_sort(list_distinct(regexp_extract_all(new, '\d+(?:\.\d+)?'))) AS d, len(list_filter({TERMS}, lambda x: contains(old, x) AND NOT contains(new, x))) = 0 AS l, len(regexp_extract_all(old, '(?m)[①-⑳]|^\d+\.')) = len(regexp_extract_all(new, '(?m)[①-⑳]|^\d+\.')) AS s FROM n)""")
    + "SELECT doc_id, number AS article_number, h AS header_preserved, d AS numbers_intact, l AS legal_terms_intact, s AS structure_preserved, h AND d AND l AND s AS is_valid, md5(doc_id || '_' || number || '_0.4.0') AS cache_key FROM k",
}

PROFILED = r"prof AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'law_hr' WHEN doc_id % 5 = 1 THEN 'law_terms' WHEN contains(text, '기본정신') THEN 'law_hr' WHEN len(regexp_extract_all(text, '제\d+조')) > 5 THEN 'law_generic' ELSE 'vlm_general' END AS profile, CASE WHEN regexp_matches(text, '제\d+조') THEN 'legal' WHEN contains(text, '[별표') THEN 'annex_only' ELSE 'unknown' END AS route FROM docs)"
#: The annexes with both tables as text, the part of the text that belongs to each table, and its rows or those of the rule.
TABLE_TEXTS = r"""WITH texts AS (SELECT c_custkey AS doc_id, '[별표1] 승진후보자범위(3급승진제외)' || chr(10) || coalesce((SELECT string_agg(n || ' ' || (5 * n + c_custkey % 4) || '번까지' || chr(10), '' ORDER BY n) FROM range(1, 76) t(n) WHERE n <= CASE WHEN c_custkey % 2 = 0 THEN 75 ELSE c_custkey % 75 END), '')
  || CASE WHEN c_custkey % 5 <> 0 THEN '승진후보자범위(3급승진)' || chr(10) || coalesce((SELECT string_agg(n || ' ' || (2 * n + c_custkey % 3) || '번까지' || chr(10), '' ORDER BY n) FROM range(1, 76) t(n) WHERE n <= CASE WHEN c_custkey % 3 = 0 THEN 75 ELSE c_custkey % 60 END), '') ELSE '' END || '[별표2] 응시자격' || chr(10) || '1 900번까지' || chr(10) AS text FROM customer),
parts AS (SELECT doc_id, 'annex_1_3급승진제외' AS table_id, string_split(string_split(string_split(text, '(3급승진제외)')[2], '승진후보자범위(3급승진)')[1], '[별표2]')[1] AS part FROM texts UNION ALL SELECT doc_id, 'annex_1_3급승진', string_split(text, '승진후보자범위(3급승진)')[2] FROM texts),
found AS (SELECT doc_id, table_id, regexp_extract_all(coalesce(part, ''), '(?m)^\d+\s+\d+번까지') AS m FROM parts),
told AS (SELECT doc_id, table_id, len(m) < 75 AS is_generated, CASE WHEN len(m) < 75 THEN 75 ELSE len(m) END AS n_rows, CASE WHEN len(m) >= 75 THEN list_sum(list_transform(m, lambda x: regexp_extract(x, '\s(\d+)', 1)::BIGINT)) WHEN table_id = 'annex_1_3급승진' THEN list_sum(list_transform(range(1, 76), lambda n: 2 * n)) ELSE list_sum(list_transform(range(1, 76), lambda n: CASE WHEN n <= 5 THEN 5 * n ELSE 25 + 3 * (n - 5) END)) END AS ranks FROM found) """
#: Texts whose headers are mostly loose, line by line: a loose one counts if there are fewer than five strict ones, none has its number, and no reference is near it.
LOOSE_TEXTS = rf"""WITH ln AS (SELECT c_custkey AS doc_id, j, CASE WHEN (c_custkey + j) % 4 = 0 OR j < 7 AND c_custkey % 7 = 0 THEN '제' || j || '조(목적 ' || j || ') ' || c_custkey ELSE '제' || j || '조 ' || CASE WHEN (c_custkey + 2 * j) % 5 = 0 THEN '제9조제2항에 따라 ' WHEN (c_custkey + j) % 6 = 1 THEN '제2조 및 제3조의 ' ELSE '' END || c_custkey END
  || ' ' || repeat('직원은 맡은 업무를 성실하게 처리하고 그 결과를 지체 없이 보고하여야 하며 필요한 사항은 따로 정하는 바에 따른다. ', (1 + (c_custkey + j) % 3)::INT) AS line FROM customer, range(1, 8) t(j)),
tx AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY j) AS text FROM ln GROUP BY doc_id),
at_ AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos, regexp_extract(line, '^제\d+조', 0) AS matched, regexp_matches(line, '^제\d+조\s*\(') AS strict, regexp_matches(line, '^제\d+조(\s|$)') AS loose FROM ln),
named AS (SELECT doc_id, list(DISTINCT matched) FILTER (strict) AS names FROM at_ GROUP BY doc_id),
hd AS (SELECT a.*, text, CASE WHEN strict THEN 'article' ELSE 'article_loose' END AS type FROM at_ a JOIN named USING (doc_id) JOIN tx USING (doc_id) WHERE strict OR loose AND coalesce(len(names), 0) < 5 AND NOT coalesce(list_contains(names, matched), false)
  AND NOT regexp_matches(substring(text, greatest(pos - 50, 0) + 1, least(pos + length(matched) + 50, length(text)) - greatest(pos - 50, 0)), '제\d+조제\d+[항호]|제\d+조\s*[및과]\s*제\d+조')),
pc AS (SELECT *, {strip("substring(text, pos + 1, coalesce(lead(pos) OVER (PARTITION BY doc_id ORDER BY pos), length(text)) - pos)")} AS content FROM hd) """
ITEMS = ", ".join(f"'{{\"key\":\"{k}\",\"type\":\"T\",\"value\":\"' || {v} || '\"}}'" for k, v in (("총액", "price || ' 원'"), ("시각", "(k % 24) || ':05 출발'"), ("걸린 시간", "(k % 60) || ' 분'"), ("비고", "':'"), ("총액", "'1 원'")))
FIELDS = ", ".join(f"'\"{k}\":\"' || {v} || '\"'" for k, v in (("총액", "price || ' 원'"), ("시각", "(k % 24) || ':05 출발'"), ("걸린 시간", "(k % 60) || ' 분'"), ("비고", "':'")))
PAIR_TEXTS = f"""WITH o AS (SELECT o_orderkey AS k, CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) AS price FROM orders),
b AS (SELECT k, '[' || concat_ws(',', {ITEMS}) || ',"odd",7,{{"key":"n","value":12}},{{"key":"x"}}]' AS l, '{{' || concat_ws(',', {FIELDS}) || ',"n":12,"x":null}}' AS m FROM o),
raws AS (SELECT k, CASE WHEN k % 5 < 2 THEN l WHEN k % 5 = 2 THEN m WHEN k % 5 = 3 THEN substring(m, 1, length(m) - 3) WHEN k % 2 = 0 THEN '17' END AS raw FROM b),
kinds AS (SELECT k, raw, CASE WHEN raw IS NULL THEN NULL WHEN NOT json_valid(raw) THEN 'broken' WHEN json_type(raw) = 'ARRAY' THEN 'list' WHEN json_type(raw) = 'OBJECT' THEN 'map' ELSE 'other' END AS layout FROM raws),
items AS (SELECT k, layout, unnest(range(1, n + 1)) AS pos, unnest(x) AS x FROM (SELECT k, layout, json_extract(raw, '$[*]') AS x, len(json_extract(raw, '$[*]')) AS n FROM kinds WHERE layout = 'list')),
prs AS (SELECT k, pos, json_extract_string(x, '$.key') AS key, json_extract_string(x, '$.value') AS value FROM items UNION ALL SELECT k, 0, key, json_extract_string(raw, '$."' || key || '"') FROM (SELECT k, raw, unnest(json_keys(raw)) AS key FROM kinds WHERE layout = 'map')) """
SQL |= {
    "kvs_layouts": PAIR_TEXTS + "SELECT d.k AS o_orderkey, d.layout, count(p.key) AS keys, count(p.value) AS values, CASE WHEN d.layout = 'broken' THEN md5(any_value(d.raw)) END AS broken_md5 FROM kinds d LEFT JOIN prs p ON p.k = d.k GROUP BY d.k, d.layout",
    "kvs_json": PAIR_TEXTS + r"""SELECT k AS o_orderkey, key, v AS value FROM (SELECT *, CASE WHEN value LIKE '% 원' THEN format('{:,}', regexp_extract(value, '^\d+')::BIGINT) || '원' WHEN value LIKE '%출발' THEN lpad(regexp_extract(value, '^\d+'), 2, '0') || ':05' WHEN value LIKE '% 분' THEN regexp_extract(value, '^\d+') || '분' ELSE value END AS v FROM prs WHERE key <> '' AND trim(value) <> '' AND value <> ':') QUALIFY row_number() OVER (PARTITION BY k, key ORDER BY length(v) DESC, pos) = 1""",
    "loose_pieces": LOOSE_TEXTS + "SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS chunk_index, type, matched AS boundary, CASE WHEN strict THEN regexp_extract(line, '\\(([^)]+)\\)', 1) END AS title, pos, md5(content) AS content_md5, CAST(length(content) AS BIGINT) AS char_count FROM pc WHERE length(content) >= 100",
    "loose_share": LOOSE_TEXTS + "SELECT doc_id, round(avg((type = 'article_loose')::INT), 6) AS loose_ratio, avg((type = 'article_loose')::INT) > 0.3 AS loose_ratio_high FROM pc WHERE length(content) >= 100 GROUP BY doc_id",
    "tables_of_texts": TABLE_TEXTS + "SELECT doc_id, table_id, is_generated, CAST(n_rows AS BIGINT) AS n_rows, CAST(ranks AS BIGINT) AS ranks FROM told",
    "tables_of_texts_stats": TABLE_TEXTS + "SELECT table_id, count(*) AS documents, CAST(sum(n_rows) AS BIGINT) AS rows, count(*) FILTER (NOT is_generated) AS own_documents, CAST(sum(n_rows) FILTER (NOT is_generated) AS BIGINT) AS own_rows FROM told GROUP BY table_id",
    "chunk_totals": cte(*CHUNKS, PROFILED) + "SELECT profile, route, type, CAST(grouping(profile, route, type) AS BIGINT) AS grouping, count(*) AS chunks, CAST(sum(length(content)) AS BIGINT) AS chars FROM made JOIN prof USING (doc_id) GROUP BY CUBE (profile, route, type)",
    "event_sessions": "WITH s AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS first FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), r AS (SELECT *, sum(first) OVER (PARTITION BY user_id ORDER BY ts) AS n FROM s) SELECT user_id, epoch_us(min(ts)) AS started, epoch_us(max(ts)) AS ended, count(*) AS events, round(sum(value), 4) AS total FROM r GROUP BY user_id, n",
    "in_transit": "SELECT r.o_orderkey, count(*) AS line_items, CAST(sum(l.l_quantity) AS BIGINT) AS pieces, epoch_us(min(l.l_shipdate)) AS first_sent FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey JOIN orders r ON r.o_custkey = o.o_custkey AND l.l_shipdate <= r.o_orderdate + INTERVAL 14 DAY AND r.o_orderdate <= l.l_shipdate + l.l_quantity::INT * INTERVAL 1 DAY GROUP BY r.o_orderkey",
    "errors_around": "SELECT e.event_id, count(*) AS events, count(DISTINCT o.user_id) AS users FROM events e JOIN events o ON o.event_type <> 'error' AND o.ts <= e.ts + INTERVAL 10 MINUTE AND e.ts <= o.ts + INTERVAL 15 MINUTE WHERE e.event_type = 'error' GROUP BY e.event_id",
    "last_event": "WITH o AS (SELECT o_orderkey, o_custkey % 200 AS user_id, TIMESTAMP '2024-01-01' + to_seconds(o_orderkey * 7919 % 2592000) AS at_ FROM orders), e AS (SELECT user_id, ts, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY user_id, ts) SELECT o.o_orderkey, o.user_id, e.event_id, e.event_type, e.value FROM o ASOF LEFT JOIN e ON e.user_id = o.user_id AND e.ts <= o.at_",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
