"""Patterns and word lists of regulation documents (fixed values).

``(?d)`` makes line feeds the only line ends; ``(?m)`` lets ``^`` and ``$``
stand at each of them.
"""

HANGUL = "[가-힣]"

# articles, chapters and what is inside them
ARTICLE = r"(제\d+조(?:의\d+)?)\s*[\(\[]([^\)\]]+)[\)\]]"
CHAPTER = r"(?d)(제\s*\d+\s*장)\s*(.+)?"
CLAUSE = r"(?md)^\s*([①-⑳])"
ITEM = r"(?md)^\s*(\d{1,2})[.)]"
DELETED = r"<삭제\s*\d{4}\.\d{2}\.\d{2}>"
AMENDED = r"(?d)\[.*?(\d{4}\.\d{2}\.\d{2}).*?\]"
ANNEX_MARK = "[별표"

# amendments: the kind and the date, in brackets, in parentheses, bare, and in angle brackets
KIND_AND_DATE = r"(전부개정|일부개정|제정|개정)\s*(\d{4}\.\d{1,2}\.\d{1,2}\.?)"
AMENDMENTS = (
    rf"\[{KIND_AND_DATE}\]",
    rf"\({KIND_AND_DATE}\)",
    rf"(?<![<\[\(]){KIND_AND_DATE}(?![>\]\)])",
    rf"<{KIND_AND_DATE}>",
)
#: Bare, with the whole date whatever stands after it.
BARE_AMENDMENT = r"(?<![<\[\(])(전부개정|일부개정|제정|개정)\s*(\d{4}\.\d{1,2}\.\d{1,2}(?!\d)\.?)"

# annexes
ANNEX_HEADER = r"\[별표\s*(\d+)\]\s*([^\n<]+)"
ANNEX_RELATED = r"<(제\d+조[^>]*)관련>"
ANNEX_DATED = r"(?d)\[(.*?(\d{4}\.\d{1,2}\.\d{1,2}).*?)\]"
HEADER_KEYWORDS = "(?i)(임용하고자|서열명부|직급|응시자격|승진|제외|구분|비고|인원수|점수|평정|평가|담당자|자격취득|경력)"
SEPARATOR_LINE = "^[-─—]{3,}$"
DIGITISH_LINE = r"^\s*(\d+[\.\)]?|\([0-9]+\)|[가-힣]\)|[A-Za-z]\))\s+"
DIGIT_LINE = r"^\d+(\s*\S+)?$"
NOTE_LIKE = r"^\*?\s*(비고|주|註|note|임용하고자)"
NOTE_LINE = r"^\*\s*(.+)$"
BOUNDARY_WORDS = ("임용하고자", "서열명부", "직급", "응시자격")
GENERIC_HINTS = ("구분", "기준", "대상", "내용", "자격", "비고", "항목", "절차", "방법", "범위", "요건", "조건")
PERSONNEL_HINTS = ("직급", "응시자격", "승진후보자범위", "서열명부순위", "임용인원수", "경력기준")
TABLE_ROWS = (r"(?md)^(\d+)\s+(\d+)번까지", r"(?md)^(\d{1,2})\s+(\d+)\s*$", r"(\d{1,2})\s+(\d+)번까지")

# page furniture
PAGE_ARTIFACT = r"^[가-힣]{2,10}\s*\d{1,5}-\d{1,3}\s*$"
PAGE_DIVIDER = r"^(?:(?i:###\s*Page\s+\d+)|(?i:Page\s+\d+)|[-—–_]{3,}|\*{3,}|={3,})\s*$"
MARKDOWN_BOX = "─━│┃┌┐└┘├┤┬┴┼╋═║╔╗╚╝╠╣╦╩╬■□▪▫"
CANONICAL_SIGNS = "□■◆◇○●▪▫◎◉★☆━┃│─├┤┬┴┼┌┐└┘"
CODE_FENCE, CODE_FENCE_END = r"```[a-zA-Z0-9_-]*\s*", r"\s*```"
PAGE_MARKERS = (r"\b\d{3,4}\s*-\s*\d{1,2}\b", r"(?i)Page\s+\d+\s*/\s*\d+", r"(?md)^\s*-\s*\d+\s*-\s*$")
PAGE_NUMBER = r"\b\d{3,4}-\d{1,2}\b"

# what is replaced in article bodies, and how numbers stand beside their units
BODY_RULES = (
    (r"(?md)제\d+장\s+[가-힣\s]+$", ""),
    (r'(?md)^\.(\s*"[가-힣]+"\s*란)', "1.$1"),
    (r"[ \t]+", " "),
    (r"\n{3,}", "\n\n"),
)
SPACING_RULES = (
    (r"제\s*(\d+)\s*조\s*의\s*(\d+)", "제$1조의$2"),
    (r"제\s*(\d+)\s*조", "제$1조"),
    (r"표\s*(\d+)", "표$1"),
    (r"\[별표\s*(\d+)\]", "[별표$1]"),
    (r"(\d+)\s*(만원|억원|천원|원)", "$1$2"),
    (r"(\d+)\s*(명|개|건|회|년|월|일)", "$1$2"),
    (r"(\d{4})\.\s*(\d{1,2})\.\s*(\d{1,2})", "$1.$2.$3"),
)
CLOSE_UNITS = ("원", "분", "%")
#: Article numbers up to this one are taken for real.
LAST_ARTICLE = 200
ARTICLE_NUMBER = r"제\s?(\d+)조(?:의\s?(\d+))?"

# chunk boundaries
STRICT = r"(?md)^[\s⟨<\[]*(제\s*\d+(?:의\d+)?\s*조)\s*\("
LOOSE = r"(?md)^[\s⟨<\[]*(제\s*\d+(?:의\d+)?\s*조)(?=\s|$)"
CHAPTER_LINE = r"(?md)^[\s⟨<\[]*(제\s*\d+\s*장)"
PREAMBLE = r"[\s⟨<\[]*(기\s*본\s*정\s*신)[\s⟩>\]]*"
INLINE_REFERENCE = r"제\d+조제\d+[항호]|제\d+조\s*[및과]\s*제\d+조"
SPECIAL_SECTIONS = ("기본정신", "기본 정신", "개정이력")
LINE_HEADERS = (
    r"^###?\s*제\s*(\d+)조(?:의\s*(\d+))?\s*\(([^)]+)\)",
    r"^제\s*(\d+)조(?:의\s*(\d+))?\s*\(([^)]+)\)",
    r"^###?\s*제\s*(\d+)조(?:의\s*(\d+))?[^(]",
)

# headers that both sides of a comparison must have
GATE_STRICT = r"제\s*(\d+)\s*조(?:의\s*(\d+))?\s*\("
GATE_LOOSE = r"제\s*(\d+)\s*조(?:의\s*(\d+))?(?=\s|$)"

# classification
HAS_ARTICLES, HAS_ANNEX, HAS_FORM = r"제\s*\d+\s*조", "별표|별지", r"별지\s*[제]?\s*\d+\s*호\s*서식"
ARTICLE_TOKENS = (r"제\s?\d+조", r"제\s?\d+항", r"제\s?\d+호", r"\(\d+\)", "[①-⑩]", r"(?md)^\d+\.")
NUMBERED_LINE = r"^\s*(?:\d+\.|\d+\)|[①-⑳]|\(\d+\))"
BUS_WORDS = ("노선", "배차", "정류장", "첫차", "막차", "차고지", "버스")
REVISION_WORDS = ("개정", "차", "제정", "시행")
FULL_DATE = r"\d{4}\.\d{1,2}\.\d{1,2}"

# rewriting
LEGAL_TERMS = ("정직", "해임", "파면", "임용", "승진", "전보", "겸임", "휴직", "복직", "면직", "강등", "징계", "채용", "결격", "부칙", "개정", "시행", "제정")
CLAUSE_MARKS = r"(?md)[①-⑳]|^\d+\."
PARTICLES = ("은", "는", "이", "가", "을", "를", "과", "와", "에", "에서", "에게", "로", "으로")
