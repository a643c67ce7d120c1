"""Column functions over text: sentences, labels, references, titles and truncation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Marks that end a sentence, and those that a lossy split drops.
SENTENCE_END, SENTENCE_DROP = "。！？；…", "。！？；"
#: Characters of numerals, and words that ask for tables and for paragraphs.
NUMERALS = "一二三四五六七八九十百千零壹貳參肆伍陸柒捌玖拾佰仟萬億兆"
TABLE_WORDS = r"(?i)表|tables?|圖表|列表"
PARAGRAPH_WORDS = r"(?i)段落|paragraphs?|內文|正文"
NOTE_PREFIXES = ("note:", "註:", "說明:")


def sentences(text: Column) -> Column:
    """Sentences with their end marks, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(text, f"(?<=[{SENTENCE_END}])"), lambda x: F.trim(x)), lambda x: x != "")


def paragraphs(text: Column) -> Column:
    """Trimmed parts between blank lines, without empty ones."""
    return F.filter(F.transform(F.split(text, r"\n\s*\n"), lambda x: F.trim(x)), lambda x: x != "")


def resentenced(text: Column) -> Column:
    """Sentences without their marks, joined by a full stop of the script; one at the end only if there was a mark."""
    kept = F.filter(F.transform(F.split(text, f"[{SENTENCE_DROP}]"), lambda x: F.trim(x)), lambda x: x != "")
    return F.concat(F.array_join(kept, "。"), F.when(text.rlike(f"[{SENTENCE_DROP}]") & (F.size(kept) > 0), "。").otherwise(""))


def comparable(text: Column) -> Column:
    """For comparing: white space collapsed, bars made full-width, trimmed, lower case."""
    return F.lower(F.trim(F.translate(F.regexp_replace(text, r"\s+", " "), "|", "｜")))


def clean_cell(text: Column) -> Column:
    """One line with single spaces; null is written out."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("None")), r"\s+", " "))


def label_key(text: Column) -> Column:
    """All white space taken out."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\s　]+", "")


def panel_name(text: Column) -> Column:
    """Without what stands in brackets, trimmed."""
    return F.trim(F.regexp_replace(text, r"\s*\(.*?\)\s*", ""))


def pairs_line(entries: Column, joiner: str) -> Column:
    """``key: value`` of an array of (key, value) structs, without keys that start with two underscores and blank values."""
    shown = F.filter(entries, lambda e: ~e["key"].startswith("__") & (F.trim(F.coalesce(e["value"], F.lit(""))) != ""))
    return F.array_join(F.transform(shown, lambda e: F.concat(e["key"], F.lit(": "), F.trim(e["value"]))), joiner)


def column_sentence(name: Column, first: Column, n: Column) -> Column:
    """``name: a, b, c`` with the first of ``n`` values, and the number of the rest."""
    more = n - F.size(first)
    return F.concat(name, F.lit(": "), F.array_join(first, ", "), F.when(more > 0, F.concat(F.lit(" (+"), more.cast("string"), F.lit(")"))).otherwise(""))


def _numbered(name: Column, words: str) -> Column:
    """The number of the first part of a file name that is one of the words and a number; null without one."""
    part = rf"^(?:{words})0*([0-9]{{1,4}})$"
    return F.regexp_extract(F.get(F.filter(F.split(F.lower(name), r"[_\-\s.]"), lambda x: x.rlike(part)), 0), part, 1).cast("int")


def page_of_file(name: Column) -> Column:
    """Page number in a file name, by a page word or else as its last part; null without one."""
    parts = F.split(F.regexp_replace(F.lower(name), r"\.[a-z0-9]+$", ""), r"[_\-]")
    last = F.when(F.size(parts) > 1, F.regexp_extract(F.element_at(parts, -1), "^0*([0-9]{1,4})$", 1))
    return F.coalesce(_numbered(name, "page|pg|p|頁"), F.nullif(last, F.lit("")).cast("int"))


def table_of_file(name: Column) -> Column:
    """Table number in a file name; null without one."""
    return _numbered(name, "table|tbl|表")


#: A page reference is numbers, one or two with a word between, after a page word or before a page sign.
_BETWEEN, _BEFORE, _SIGN = r"\s*[-到至]\s*", r"(?:pages?|p\.?|[页頁]s?)\s*", r"\s*[页頁]"


def _numbers(digit: str) -> str:
    return rf"({digit}+)(?:{_BETWEEN}({digit}+))?"


def _span(first: Column, last: Column) -> Column:
    return F.transform(F.filter(F.arrays_zip(first.alias("a"), last.alias("b")), lambda x: (x["b"] == "") | (x["a"].cast("bigint") <= x["b"].cast("bigint"))), lambda x: F.sequence(x["a"].cast("bigint"), F.when(x["b"] == "", x["a"]).otherwise(x["b"]).cast("bigint")))


def page_numbers(text: Column) -> Column:
    """Sorted distinct pages that a question names in digits; ranges are expanded. A lone number before a page sign needs its ordinal mark."""
    group = lambda pattern, k: F.regexp_extract_all(text, F.lit(pattern), F.lit(k))
    after_word = f"(?i){_BEFORE}{_numbers('[0-9]')}"
    before_sign = rf"(第\s*)?{_numbers('[0-9]')}{_SIGN}"
    marked = F.filter(F.arrays_zip(group(before_sign, 1).alias("m"), group(before_sign, 2).alias("a"), group(before_sign, 3).alias("b")), lambda x: (x["m"] != "") | (x["b"] != ""))
    spans = F.concat(_span(group(after_word, 1), group(after_word, 2)), _span(F.transform(marked, lambda x: x["a"]), F.transform(marked, lambda x: x["b"])))
    return F.array_sort(F.array_distinct(F.flatten(spans)))


def content_types(text: Column) -> Column:
    """Types a question asks for; a table word anywhere stands for rows and summaries."""
    none = F.array().cast("array<string>")
    table = F.when(text.rlike(TABLE_WORDS), F.array(F.lit("table_row"), F.lit("table_summary"))).otherwise(none)
    return F.concat(table, F.when(text.rlike(PARAGRAPH_WORDS), F.array(F.lit("paragraph"))).otherwise(none))


def clean_query(text: Column) -> Column:
    """The question without page references and type words, punctuation and white space collapsed."""
    digit = f"[{NUMERALS}0-9]"
    reference = rf"{_BEFORE}{_numbers('[0-9]')}|第\s*{_numbers(digit)}{_SIGN}"
    kinds = rf"(?:表格?|tables?\s*){digit}*|段落|paragraphs?"
    return F.trim(F.regexp_replace(F.regexp_replace(text, f"(?i){reference}|{kinds}", ""), r"[，。、\s]+", " "))


def valid_doc_id(raw: Column) -> Column:
    """A document id without end punctuation, what follows ``.pdf``, quotes and extension; null if at most 4 characters are left."""
    cut = F.regexp_replace(F.regexp_replace(raw, r"[,.!?;:]+$", ""), r"(?i)(\.pdf).*$", "$1")
    bare = F.regexp_replace(F.regexp_replace(F.trim(cut), "^[\"']+|[\"']+$", ""), r"(?i)\.pdf$", "")
    return F.when(F.length(bare) > 4, bare)


def graph_label(raw: Column, fallback: str) -> Column:
    """Upper case, only A-Z, 0-9 and underscores, none at the ends, at most 64 characters."""
    safe = F.regexp_replace(F.upper(F.trim(F.coalesce(raw, F.lit("")))), "[^A-Z0-9_]", "_")
    safe = F.regexp_replace(safe, "^_+|_+$", "")
    return F.when(safe == "", fallback).otherwise(F.substring(safe, 1, 64))


def graph_properties(props: Column) -> Column:
    """A string map with keys of at most 64 and values of at most 1,000 characters."""
    return F.transform_values(F.transform_keys(props, lambda k, _: F.substring(k, 1, 64)), lambda _, v: F.substring(v, 1, 1000))


def room_title(message: Column, default: str = "New room") -> Column:
    return F.coalesce(F.nullif(F.substring(F.trim(message), 1, 12), F.lit("")), F.lit(default))


def model_title(answer: Column, default: str = "New room") -> Column:
    """The last line that is not blank, without quotes; the default beyond 30 characters or if empty."""
    lines = F.filter(F.transform(F.split(answer, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    last = F.regexp_replace(F.coalesce(F.get(lines, F.size(lines) - 1), F.lit("")), "[\"'「」『』]", "")
    return F.when((last == "") | (F.length(last) > 30), default).otherwise(last)


def truncated(text: Column, most: int, mark: str = "...") -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit(mark))).otherwise(text)


def json_or_wrapped(answer: Column) -> Column:
    """The answer if it is JSON, wrapped as one if it has CJK characters, else an error object."""
    wrapped = F.to_json(F.struct(answer.alias("response")))
    valid = F.try_parse_json(answer).isNotNull()
    return F.when(valid, answer).when(answer.rlike(r"[一-鿿]"), wrapped).otherwise(F.lit('{"error":"not JSON"}'))


def safe_file_name(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(name, r"[^\w.\-]+", "_"), r"^[._]+", "")


def doc_id_of_file(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.[^.]*$", "")


def parsed_questions(answer: Column, most: int) -> Column:
    """Questions of a list, one a line: bullets and the number due taken off, short lines and notes left out, a mark added, at most ``most``."""
    lines = F.filter(F.transform(F.split(F.trim(answer), "\n"), lambda x: F.trim(x)), lambda x: x != "")

    def bare(done: Column, line: Column) -> Column:
        out = line
        number = (F.size(done) + 1).cast("string")
        for prefix in (F.concat(number, F.lit("、")), F.concat(number, F.lit(". ")), F.lit("• "), F.lit("- ")):
            out = F.when(F.startswith(line, prefix), F.trim(F.substring(line, F.length(prefix) + 1, F.length(line)))).otherwise(out)
        return out

    def step(done: Column, line: Column) -> Column:
        text = bare(done, line)
        low = F.lower(text)
        skip = (F.length(text) < 5) | low.startswith(NOTE_PREFIXES[0]) | low.startswith(NOTE_PREFIXES[1]) | low.startswith(NOTE_PREFIXES[2]) | (F.size(done) >= most)
        marked = F.when(text.endswith("？") | text.endswith("?"), text).otherwise(F.concat(text, F.lit("？")))
        return F.when(skip, done).otherwise(F.concat(done, F.array(marked)))

    return F.aggregate(lines, F.array().cast("array<string>"), step)


#: Marks of a question and of its answer, each followed by a colon.
QA_MARKS = (("Q", "A"), ("問題", "回答"), ("問", "答"))


def qa_pairs(text: Column) -> Column:
    """(question, answer) structs by the pairs of QA_MARKS; an answer ends at the next mark. Questions over 5 and answers over 10 characters."""
    colon = "[:：]"
    mark = "(?:" + "|".join(q for q, _ in QA_MARKS) + ")" + colon
    out = []
    for q, a in QA_MARKS:
        pattern = rf"(?si)(?<![A-Za-z]){q}{colon}((?:(?!{mark}).)*?)(?<![A-Za-z]){a}{colon}(.*?)(?=(?<![A-Za-z]){mark}|$)"
        asked, answered = (F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(k)), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")) for k in (1, 2))
        out.append(F.zip_with(asked, answered, lambda x, y: F.struct(x.alias("question"), y.alias("answer"))))
    return F.filter(F.concat(*out), lambda p: (F.length(p["question"]) > 5) & (F.length(p["answer"]) > 10) & (p["question"] != p["answer"]))
