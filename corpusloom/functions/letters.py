"""Vietnamese official letters: what marks one, and which of its lines are not its body, as SQL over lines.

A letter's lines get one flag a rule; rules belong to zones (anywhere, the head, the table of contents, the list of
recipients, the foot). A zone that lines open and close is a window: it is open where the last line that opens it
comes after the last that closes it. No line is looked at one after another, so all letters are cleaned by one shuffle.
"""

from __future__ import annotations

from corpusloom.functions import text as t

#: Phrases and formats of official letters, in lower case; a space stands for white space, which scans may lose.
NATION = ("cộng hòa xã hội chủ nghĩa việt nam",)
MOTTO = ("độc lập [-–—] tự do [-–—] hạnh phúc",)
DOCUMENT_TYPES = ("quyết định", "thông tư", "nghị quyết", "công văn", "tờ trình", "báo cáo", "đồ án")
ACADEMIC_TITLES = ("báo cáo", "đồ án", "tốt nghiệp", "mssv", "lớp", "hướng dẫn", "họ tên", "đề tài")
ACADEMIC_FIELDS = ("họ tên", "mssv", "lớp", "người hướng dẫn", "tên đề tài", "đề tài")
OFFICES = ("ủy ban nhân dân", "bộ", "sở", "tổng cục", "cục", "tòa án nhân dân", "viện kiểm sát", "đảng cộng sản", "ban chấp hành", "hội đồng nhân dân", "ủy ban mặt trận", "công ty", "phân hiệu", "bộ môn", "trường")
CONTACTS = ("điện thoại", "tel", "fax", "email", "website", "hotline")
FOOTERS = ("quyết định số", "thông tư số", "nghị quyết số")
SCANS = ("văn bản gốc tại", "quét bởi", "printed by", r"\[ocr.*\]", "trang [0-9]+ bản gốc")
SIGNERS = ("chủ tịch", "phó chủ tịch", "bộ trưởng", r"kt\. bộ trưởng", "thứ trưởng", "giám đốc", "phó giám đốc", "tổng giám đốc", "đã ký", "ký bởi", "ngày ký", "quyết nghị", r"tm\. hội đồng", r"tm\. ủy ban", "xác nhận của", "sinh viên")
SIGN_HERE = ("kí , ghi rõ họ tên", r"\( kí")
NUMBER = "số *: *[0-9]+(?:/[a-z0-9-]+)*"
DATE = "(?:[\\p{L}\\p{N}_\\s,.-]{0,40},?\\s*)?ngày +[0-9]{1,2} +tháng +[0-9]{1,2} +năm +[0-9]{4}"
PAGE = "^(?:trang *)?[0-9]+(?: */ *[0-9]+)?$"
LEADER = r"\.{4,} *[0-9]+$"
ITEM = r"^[-+*•●▪▫‣0-9./)]"
NAME = "^[A-ZÀ-ỸĐ][a-zà-ỹđ]+(?: +[A-ZÀ-ỸĐ][a-zà-ỹđ]+){1,3}$"
APPENDIX = "^(?:phụ *lục(?: +[a-z0-9]+)?|phụ +lục +kèm +theo)$"
CONTENTS, RECIPIENTS = "^mục +lục$", "^nơi +nhận *: *$"
#: The head's lines in texts and in lists of elements; where the foot and its end begin; longest office line, longest recipient, longest entry of contents.
HEAD_LINES, HEAD_ELEMENTS, FOOT, END, OFFICE_WORDS, RECIPIENT_WORDS, CONTENTS_WORDS = 25, 18, 0.65, 0.8, 15, 5, 10

STOP = "(?:[^\\p{L}\\p{N}_]|$)"
FRONT = "(?:^|[^\\p{L}\\p{N}_])"


def spaced(phrases: tuple[str, ...], least: str = "*") -> str:
    return "(?:" + "|".join(p.replace(" ", f"\\s{least}") for p in phrases) + ")"


def wide(pattern: str) -> str:
    return pattern.replace(" *", "\\s*").replace(" +", "\\s+")


def is_letter(d, x="text"):
    """Two marks and a title, or nation and motto, or a number and a document's type."""
    low = f"lower({t.text(d, x)})"
    has = lambda p, w="": f"(contains({low}, '{w}') AND {d.rx_like(low, p)})" if w and d.name == "spark" else d.rx_like(low, p)  # noqa: E731  Spark looks for a word of the pattern first
    nation, motto = has(spaced(NATION), "cộng"), has(spaced(MOTTO), "độc")
    number, date = has(FRONT + wide(NUMBER) + STOP, "số"), has("(?m)(?:^|[,.\\n]\\s*)" + wide(DATE) + STOP, "ngày")
    kind, academic = has("(?m)^\\s*" + spaced(DOCUMENT_TYPES) + STOP), has("(?m)^\\s*" + spaced(ACADEMIC_TITLES, "+") + STOP)
    marks = " + ".join(f"CASE WHEN {m} THEN 1 ELSE 0 END" for m in (nation, motto, number, date))
    return f"(({marks}) >= 2 AND ({kind} OR {academic}) OR {nation} AND {motto} OR {number} AND {kind})"


#: Zone and test of each rule; ``x``: the trimmed line, ``y``: in lower case, ``words``: its words.
RULES = {
    "anywhere": lambda d: (d.rx_like("y", spaced(SCANS, "+")), d.rx_like("y", wide(PAGE)), d.rx_like("y", "^" + spaced(FOOTERS, "+") + "\\s*:\\s*[0-9]"), d.rx_like("y", FRONT + spaced(CONTACTS, "+") + "\\s*:")),
    "head": lambda d: (
        d.rx_like("y", spaced(NATION + MOTTO)),
        d.rx_like("y", FRONT + wide(NUMBER) + STOP),
        d.rx_like("y", "(?:^|[,.]\\s*)" + wide(DATE) + STOP),
        d.rx_like("y", "^" + spaced(ACADEMIC_FIELDS) + "\\s*:"),
        f"{d.rx_like('y', '^' + spaced(OFFICES))} AND words < {OFFICE_WORDS}",
    ),
    "sign": lambda d: (d.rx_like("y", spaced(SIGN_HERE)),),
    "title": lambda d: (d.rx_like("y", "^" + spaced(SIGNERS).replace("\\s*", " ")),),
    "appendix": lambda d: (d.rx_like("y", wide(APPENDIX)),),
}


def body(d, lines: str, head: int) -> str:
    """(doc_id, i) of the lines that stay: ``lines`` has (doc_id, i, line) of letters, numbered from 0 and blank ones included."""
    flag = lambda zone: "(" + " OR ".join(RULES[zone](d)) + ")"
    last = lambda when: f"coalesce(max(CASE WHEN {when} THEN i END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), -1)"
    return f"""
SELECT doc_id, i FROM (
  SELECT *, lag(signer) OVER (PARTITION BY doc_id ORDER BY i) AS after_signer FROM (
    SELECT *, in_foot AND NOT early AND NOT listed AND title AS signer FROM (
      SELECT *, NOT early AND (recipients OR entry AND {last('NOT early AND recipients')} > {last('NOT early AND NOT recipients AND NOT entry')}) AS listed FROM (
        SELECT *, anywhere OR contents OR leader AND {last('NOT anywhere AND contents')} > {last(f'NOT anywhere AND NOT leader AND words > {CONTENTS_WORDS}')} OR i < {head} AND in_head AS early FROM (
          SELECT doc_id, i, words, {flag('anywhere')} AS anywhere, {d.rx_like('y', wide(CONTENTS))} AS contents, {d.rx_like('y', wide(LEADER))} AS leader, {flag('head')} AS in_head,
            {d.rx_like('y', wide(RECIPIENTS))} AS recipients, {d.rx_like('x', ITEM)} OR words < {RECIPIENT_WORDS} AS entry, i > floor({FOOT} * n) AS in_foot, i > floor({END} * n) AS at_end,
            {flag('sign')} AS sign, {flag('title')} AS title, {d.rx_like('x', wide(NAME))} AS name, {flag('appendix')} AS appendix
          FROM (SELECT *, lower(x) AS y, {d.size(t.tok_e(d, 'x'))} AS words FROM (SELECT doc_id, i, {d.rx_rep('line', '^\\s+|\\s+$', '')} AS x, count(*) OVER (PARTITION BY doc_id) AS n FROM ({lines}) l0) l1 WHERE x <> '') l2) l3) l4) l5) l6) l7
WHERE NOT (early OR listed OR signer OR in_foot AND sign OR name AND (coalesce(after_signer, false) OR at_end) OR appendix)"""


def lines_of(d, source: str) -> str:
    """(doc_id, i, line) of each line of ``source`` (doc_id, text)."""
    return f"SELECT doc_id, {d.numbered('a', 'i', 'line')} FROM (SELECT doc_id, {d.rx_split(t.text(d), '\\r?\\n|\\r')} AS a FROM {source}) s"
