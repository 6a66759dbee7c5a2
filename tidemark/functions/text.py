"""Scalar functions on text, markup, links and timestamps."""

from __future__ import annotations

import html
import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.schemas import ZONE

#: Entities that the SQL twin knows as well; ``clean_html`` goes through all others in Python.
COMMON_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))
# fixed values: the hosts that pages may come from
ARTICLE_HOSTS = ("vietstock.vn", "www.vietstock.vn", "finance.vietstock.vn")

# fixed values: Vietnamese cues of negative and positive news
NEGATIVE_CUES = (
    "lỗ", "thua lỗ", "lỗ ròng", "lỗ lũy kế", "âm vốn", "giảm lãi", "lãi giảm", "sụt giảm", "lao dốc", "giảm sàn", "bán tháo",
    "doanh thu giảm", "lợi nhuận giảm", "kém khả quan", "suy giảm", "nợ xấu", "quá hạn", "chậm thanh toán", "chậm trả",
    "mất khả năng thanh toán", "vỡ nợ", "gia hạn nợ", "cơ cấu nợ", "xử phạt", "vi phạm", "phạt hành chính", "truy thu", "cưỡng chế",
    "khởi tố", "bắt tạm giam", "điều tra", "thanh tra", "kiểm toán ngoại trừ", "ý kiến ngoại trừ", "hồi tố", "đình chỉ",
    "hủy niêm yết", "hạn chế giao dịch", "cảnh báo", "kiểm soát", "rút giấy phép", "thu hồi", "giải chấp", "bán giải chấp",
    "call margin", "thoái vốn bắt buộc", "chậm công bố", "chậm nộp", "kiện", "tranh chấp", "khiếu nại", "thu hồi sản phẩm",
    "hoãn", "trì hoãn", "chậm tiến độ", "dừng dự án", "từ nhiệm", "miễn nhiệm", "bán ra", "đăng ký bán",
)
POSITIVE_CUES = (
    "lãi", "lợi nhuận tăng", "lãi tăng", "tăng trưởng", "vượt kế hoạch", "hoàn thành kế hoạch", "kỷ lục", "cao nhất", "khởi sắc",
    "doanh thu tăng", "trúng thầu", "ký hợp đồng", "mở rộng", "chia cổ tức", "cổ tức", "thưởng cổ phiếu", "mua vào", "đăng ký mua",
    "khối ngoại mua", "nâng khuyến nghị", "tăng trần", "bứt phá", "khánh thành", "đưa vào hoạt động", "phê duyệt", "chấp thuận",
    "hợp tác chiến lược", "đối tác chiến lược", "rót vốn", "giải ngân",
)


def blank_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def collapse(text: Column) -> Column:
    """Runs of ASCII white space become a space; ends are trimmed; nothing left is null."""
    return blank_to_null(F.trim(F.regexp_replace(text, "[ \\t\\n\\x0B\\f\\r]+", " ")))


def strip_markup(text: Column) -> Column:
    """Comments, scripts and styles with what they hold, and tags become spaces."""
    out = F.regexp_replace(text, "(?s)<!--.*?-->", " ")
    out = F.regexp_replace(out, "(?is)<(script|style)\\b[^>]*>.*?</(script|style)\\s*>", " ")
    return F.regexp_replace(out, "(?s)<[^>]+>", " ")


@F.pandas_udf(T.StringType())
def _unescape(texts: pd.Series) -> pd.Series:
    return texts.map(html.unescape, na_action="ignore")


def clean_html(text: Column, all_entities: bool = True) -> Column:
    """Text of a fragment of markup. Only the texts of rows that hold uncommon entities go through Python;
    with ``all_entities`` false everything stays in the engine."""
    stripped = out = strip_markup(text)
    for entity, char in COMMON_ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(char))
    if all_entities:
        common = "|".join(re.escape(e) for e, _ in COMMON_ENTITIES)
        uncommon = F.regexp_replace(stripped, common, " ").contains("&")
        out = F.coalesce(_unescape(F.when(uncommon, stripped)), out)
    return collapse(out)


def has_body(text: Column) -> Column:
    return F.coalesce(F.length(F.trim(text)) > 0, F.lit(False))


def https(url: Column) -> Column:
    """Links without a scheme or with plain http become https."""
    return F.regexp_replace(url, "^(http:)?//", "https://")


def allowed(url: Column, hosts: tuple[str, ...] = ARTICLE_HOSTS) -> Column:
    """https and exactly one of the hosts."""
    return F.coalesce((F.try_parse_url(url, F.lit("PROTOCOL")) == "https") & F.try_parse_url(url, F.lit("HOST")).isin(*hosts), F.lit(False))


def article_id(url: Column) -> Column:
    """The number before .htm, or the first 16 hex digits of the link's digest."""
    return F.coalesce(blank_to_null(F.regexp_extract(url, r"-(\d+)\.htm", 1)), F.substring(F.sha2(url, 256), 1, 16))


def local_time(instant: Column, zone: str = ZONE) -> Column:
    """Wall time in the zone of an instant, whatever the session's zone is."""
    return F.convert_timezone(F.current_timezone(), F.lit(zone), instant.cast("timestamp_ntz"))


def stored_time(text: Column, zone: str = ZONE) -> Column:
    """Wall time in the zone: with an offset the instant is converted, without one the value is taken as it is."""
    offset = text.rlike(r"\d[T ].*(Z|[+-]\d{2}:?\d{2})$")
    instants = F.coalesce(F.try_to_timestamp(text), F.try_to_timestamp(text, F.lit("dd-MM-yyyy HH:mm:ssXXX")))
    forms = [F.try_to_timestamp(text, F.lit(f)).cast("timestamp_ntz") for f in ("dd/MM/yyyy HH:mm", "dd-MM-yyyy HH:mm")]
    return F.when(offset, local_time(instants, zone)).otherwise(F.coalesce(text.try_cast("timestamp_ntz"), *forms))


def published_at(text: Column, zone: str = ZONE) -> Column:
    """Wall time in the study's zone of a timestamp in one of the accepted forms; a date alone is null."""
    return F.when(text.rlike("T") | (F.length(text) > 10), stored_time(text, zone))


def cue_pattern(cues: tuple[str, ...]) -> str:
    """Alternation with the longest cues first."""
    return "(" + "|".join(re.escape(c).replace(r"\ ", " ") for c in sorted(cues, key=lambda c: (-len(c), c))) + ")"


def cue_count(text: Column, cues: tuple[str, ...]) -> Column:
    """Number of distinct cues in the lower-cased text."""
    return F.size(F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(cue_pattern(cues)), F.lit(1)))).cast("long")


def input_text(variant: str, title: str = "title", body: str = "body", context_chars: int | None = None) -> Column:
    """Title, context or both with an empty line between, from what is there; null if nothing is."""
    if context_chars is not None and context_chars < 1:
        raise ValueError("context_chars must be positive")
    head, rest = (blank_to_null(F.trim(F.col(c))) for c in (title, body))
    rest = blank_to_null(F.trim(F.substring(rest, 1, context_chars))) if context_chars else rest
    if variant == "title":
        return F.coalesce(head, rest)
    if variant == "context":
        return F.coalesce(rest, head)
    if variant == "title_context":
        return blank_to_null(F.concat_ws("\n\n", head, rest))
    if variant == "text":
        return F.coalesce(blank_to_null(F.trim(F.col("text"))), F.coalesce(head, rest))
    raise ValueError(f"unknown variant {variant!r}")


def label_id(label: Column, names: tuple[str, ...] = ("NEGATIVE", "NEUTRAL", "POSITIVE")) -> Column:
    """0, 1 or 2 from a name or a whole number; null for anything else."""
    shown = F.upper(F.trim(label.cast("string")))
    out = F.when(shown == names[0], 0)
    for k, name in enumerate(names[1:], 1):
        out = out.when(shown == name, k)
    number = shown.try_cast("double")
    return out.otherwise(F.when(number.isin(0.0, 1.0, 2.0), number.cast("int")))


def strict_label_id(label: Column, names: tuple[str, ...] = ("NEGATIVE", "NEUTRAL", "POSITIVE")) -> Column:
    """As ``label_id``, but a label that is none of them raises when the row is read."""
    return F.coalesce(label_id(label, names), F.raise_error(F.concat(F.lit("invalid label: "), F.coalesce(label.cast("string"), F.lit("null")))).cast("int"))


def truncated(tokens: Column, size: int, how: str) -> Column:
    """The first, the last, or the first half (rounded up) and the last tokens."""
    head = -(-size // 2)
    short = F.size(tokens) <= size
    cut = {"head": F.slice(tokens, 1, size), "tail": F.slice(tokens, F.greatest(F.size(tokens) - size + 1, F.lit(1)), F.lit(size))}
    if how == "head_tail":
        last = F.slice(tokens, F.greatest(F.size(tokens) - (size - head) + 1, F.lit(1)), F.lit(size - head)) if size > head else F.slice(tokens, 1, 0)
        cut["head_tail"] = F.concat(F.slice(tokens, 1, head), last)
    return F.when(short, tokens).otherwise(cut[how])


def reader_label(negative: str = "prob_negative", neutral: str = "prob_neutral", positive: str = "prob_positive") -> Column:
    """The class a reader is shown: the most likely one, of equal ones positive before negative before neutral."""
    best = F.greatest(negative, neutral, positive)
    return F.when(F.col(positive) == best, "POSITIVE").when(F.col(negative) == best, "NEGATIVE").otherwise("NEUTRAL")


class Article(HTMLParser):
    """Title, body and time of an article page, from its meta tags and marked elements."""

    VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.meta: dict[str, str] = {}
        self.texts: dict[str, list[str]] = {"title": [], "body": [], "date": []}
        self.open: list[tuple[str, str | None]] = []
        self.muted = 0

    def kind(self, tag: str, attrs: dict[str, str | None]) -> str | None:
        if tag == "title":
            return "title"
        if tag == "div" and attrs.get("id") == "vst_detail" and attrs.get("itemprop") == "articleBody":
            return "body"
        if tag in ("span", "div") and attrs.get("itemprop") == "datePublished":
            return "date"
        return None

    def handle_starttag(self, tag: str, attrs) -> None:
        own = dict(attrs)
        if tag == "meta":
            name = own.get("property") or own.get("name") or own.get("itemprop")
            if name and own.get("content"):
                self.meta.setdefault(name.lower(), own["content"])
        if tag in self.VOID:
            return
        self.muted += tag in ("script", "style")
        self.open.append((tag, self.kind(tag, own)))

    def handle_endtag(self, tag: str) -> None:
        if tag not in [t for t, _ in self.open]:
            return
        while self.open:
            last, _ = self.open.pop()
            self.muted -= last in ("script", "style")
            if last == tag:
                break

    def handle_data(self, data: str) -> None:
        if self.muted:
            return
        for kind in {k for _, k in self.open if k}:
            self.texts[kind].append(data)

    def found(self) -> tuple[str | None, str | None, str | None]:
        text = {k: " ".join(" ".join(v).split()) or None for k, v in self.texts.items()}
        meta = lambda *names: next((m for n in names if (m := " ".join(self.meta.get(n, "").split()))), None)
        return meta("og:title") or text["title"], text["body"] or meta("og:description"), text["date"] or meta("article:published_time", "datepublished", "pubdate")


@F.pandas_udf(T.StructType([T.StructField(n, T.StringType()) for n in ("title", "body", "published")]))
def parse_article(pages: pd.Series) -> pd.DataFrame:
    """Batches of pages through the standard parser; a page that can't be parsed gives nulls."""
    rows = []
    for page in pages:
        parser = Article()
        if isinstance(page, str):
            parser.feed(page)
            parser.close()
        rows.append(parser.found())
    return pd.DataFrame(rows, columns=["title", "body", "published"])


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("url", "list_date")])))
def listing_links(fragments: pd.Series) -> pd.Series:
    """Article links of a listing page, each with the date nearest to it among its neighbours."""
    link, date = re.compile(r'href="([^"]+-\d+\.htm)"'), re.compile(r"\b\d{2}/\d{2}/\d{4}\b")

    def found(page) -> list[dict]:
        if not isinstance(page, str):
            return []
        hits = list(link.finditer(page))
        out = []
        for k, hit in enumerate(hits):
            low, high = hits[k - 1].end() if k else 0, hits[k + 1].start() if k + 1 < len(hits) else len(page)
            dates = [(min(abs(d.start() - hit.end()), abs(hit.start() - d.end())), d[0]) for d in date.finditer(page, low, high)]
            out.append({"url": hit[1], "list_date": min(dates)[1] if dates else ""})
        return out

    return fragments.map(found)


@F.pandas_udf(T.StringType())
def client_key(addresses: pd.Series) -> pd.Series:
    """The limiter's key of an address: IPv4 as it is, IPv6 by its /64, null if neither."""
    import ipaddress

    def key(text):
        try:
            own = ipaddress.ip_address(text)
        except ValueError:
            return None
        return str(own) if own.version == 4 else str(ipaddress.ip_network((own, 64), strict=False))

    return addresses.map(key, na_action="ignore")
