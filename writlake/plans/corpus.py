"""A corpus of court orders derived from the star schema, with its truth: the tables hold no Arabic text.

One document for each order; courts, names, numbers and dates come from its keys, and a fixed share of documents is damaged
the way OCR damages them. Everything is a function of the keys, so that both engines derive the same text.
"""

from __future__ import annotations

from writlake.functions import lexicons as L
from writlake.functions.dialect import Dialect
from writlake.plans.flow import Flow

#: Parts of names.
FIRST = ("احمد", "محمد", "سامي", "خالد", "ليلى", "سعاد", "يوسف", "رنا", "عمر", "هند", "طارق")
FATHER = ("محمود", "سالم", "حسن", "علي", "ابراهيم", "كامل", "ناصر")
FAMILY = ("المصري", "الخطيب", "العبادي", "الزعبي", "حداد", "النجار", "القضاة", "الرواشدة", "التميمي")
TRADES = ("النور", "الفجر", "الامل", "البركة", "الشرق")


def pick(d: Dialect, values: tuple[str, ...], key: str) -> str:
    return d.at(d.array(values), f"({key}) % {len(values)} + 1")


def name_of(d: Dialect, key: str) -> str:
    return f"concat_ws(' ', {pick(d, FIRST, key)}, {pick(d, FATHER, f'{key} + 3')}, {pick(d, FIRST, f'{key} * 7 + 2')}, {pick(d, FAMILY, f'{key} * 5 + 1')})"


def text_type(d: Dialect) -> str:
    return "string" if d.spark else "varchar"


def number(d: Dialect, x: str) -> str:
    return f"cast({x} as {text_type(d)})"


def documents() -> Flow:
    """document_id, truth columns, header_text, full_page_text and list_text (a page of another kind)."""
    base = Flow.table("orders", "o_orderkey", "o_custkey", "o_orderdate").add(
        document_id=lambda d: "o_orderkey", k=lambda d: "o_orderkey", c=lambda d: "o_custkey",
        court=lambda d: pick(d, L.COURTS, "o_custkey"), year=lambda d: number(d, "year(o_orderdate)"),
    )
    base = base.add(
        case_no=lambda d: f"concat({number(d, 'k % 9000 + 1')}, '/', year)",
        book_no=lambda d: f"concat('UW-', year, '-', {d.pad(number(d, 'k % 10000'), 4)})",
        day=lambda d: f"concat(year, '/', {d.pad(number(d, 'month(o_orderdate)'), 2)}, '/', {d.pad(number(d, 'day(o_orderdate)'), 2)})",
        name1=lambda d: name_of(d, "c"), id1=lambda d: number(d, "case when k % 11 = 3 then 9800000000 + c else 98000000000 + c end"),
        name2=lambda d: name_of(d, "c + k % 13 + 1"), id2=lambda d: number(d, "98100000000 + c * 17 + k % 13"),
        company=lambda d: f"concat('شركة ', {pick(d, TRADES, 'k')}, ' للتجارة')", reg=lambda d: f"concat('REG-', {number(d, '200000 + k % 5000')})",
        damage=lambda d: "cast(k % 9 as int)",
    )
    base = base.add(shown=lambda d: "case when damage = 6 then concat(substr(day, 9, 2), '/', substr(day, 6, 2), '/', year) when damage = 7 then replace(day, '/', '') else day end")
    base = base.add(header=lambda d: "concat(court, chr(10), 'رقم القضية : ', case_no, chr(10), 'رقم الكتاب : ', book_no, chr(10), case when damage = 8 then 'التاربخ' else 'التاريخ' end, ' : ', shown)")
    base = base.add(body=lambda d: "concat('إلى السادة مديرية الأراضي', chr(10), 'قررت المحكمة الحجز على اموال المستدعى ضده ', name1, ' الرقم الوطني ', id1, chr(10), 'المدين : ', name2, ' ورقم وطني (', id2, ')', chr(10), company, ' رقم التسجيل : ', reg, chr(10), 'وتفضلوا بقبول الاحترام')")

    # A page with a list of target persons, in the order its reader gives: label first, number first, a number twice, a lone first name, a number far from its label.
    base = base.add(listing=lambda d: "concat('يرجى تزويدنا بالمعلومات المتوفرة', chr(10), 'الاشخاص / الجهات المطلوبة :', chr(10), "
        "case k % 6 when 1 then concat('الرقم الوطني ', id1, ' ', name1, chr(10)) when 2 then concat('- ', substring_index_(name1), ' الرقم الوطني : ', id1, ' نوع الشخص : فرد', chr(10), 'سامي', chr(10)) "
        "when 3 then concat('- ', name1, ' الرقم الوطني : ', id1, chr(10), '- ', name2, ' الرقم الوطني : ', id1, chr(10)) else concat('- ', name1, ' | الرقم الوطني : ', id1, ' | نوع الشخص : فرد', chr(10)) end, "
        "'- ', company, ' | رقم التسجيل : ', reg, ' | نوع الشخص : شركة', chr(10), 'وتفضلوا بقبول الاحترام', chr(10), case when k % 4 = 1 then concat(name2, chr(10), 'هاتف ', id2) else concat('(', id2, ') ', name2) end)".replace("substring_index_(name1)", "array_join(slice(split(name1, ' '), 1, 3), ' ')" if d.spark else "array_to_string(list_slice(string_split(name1, ' '), 1, 3), ' ')"))  # fmt: skip

    def damaged(column: str):
        return lambda d: (
            f"case damage when 1 then {d.translate(column, L.ASCII_DIGITS, L.ARABIC_DIGITS)} when 2 then replace({column}, '/', ' / ') when 3 then replace({column}, ' : ', ' | ') "
            f"when 4 then concat('~', replace({column}, ' ', '  '), '_ ^') when 5 then replace({column}, 'ا', 'أ') else {column} end"
        )

    return base.select("document_id", "k", "c", "court", "case_no", "book_no", "day", "name1", "id1", "name2", "id2", "company", "reg", "damage", header_text=damaged("header"), full_page_text=damaged("body"), list_text=damaged("listing"))
