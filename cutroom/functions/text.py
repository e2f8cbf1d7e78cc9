"""Strings, labels and identifiers as column expressions."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..conf import EMOTIONS, SENTIMENT
from .numbers import fixed


def _bare_letters() -> tuple[str, str]:
    """Letters that lose marks, and what they become; then marks that stand alone and go. Letters such as đ, ø and ß stay."""
    letters, bare, marks = [], [], []
    for i in range(0x80, 0x10000):
        first, *rest = unicodedata.normalize("NFD", chr(i)) if not 0xD800 <= i < 0xE000 else "x"
        if rest and all(unicodedata.category(x).startswith("M") for x in rest):
            letters.append(chr(i))
            bare.append(first)
        elif unicodedata.category(chr(i)) == "Mn":
            marks.append(chr(i))
    return "".join(letters + marks), "".join(bare)


_MARKED, _BARE = _bare_letters()

# Phrases that speak for an emotion (without marks); one that stands twice counts twice.
LEXICON = {
    "happy": ("vui", "hanh phuc", "cuoi", "thich", "yeu", "tuyet", "may qua", "mung", "suong", "vui ve", "hanh phuc", "hoan hoan", "ron rang"),
    "sad": ("buon", "khoc", "dau long", "co don", "mat", "nho", "tui", "that vong", "tui nhu", "nuoc mat", "bi luy", "sau", "thuong"),
    "angry": ("gian", "tuc", "buc", "do khon", "im di", "cam", "ghet", "dien", "khong tha", "cam han", "tuc gian", "buc boi"),
    "fear": ("so", "lo", "hoang", "cuu", "nguy hiem", "chay di", "dung", "hai", "run", "rung minh", "lo lang", "bat an", "hoang loan"),
    "surprise": ("sao", "gi co", "that an", "khong the", "bat ngo", "troi oi", "ua", "chu sao", "lam sao", "that khong", "khong tin noi"),
    "disgust": ("ghe", "kinh", "tom", "ban", "khinh", "dang ghet", "buon non", "ghe tom", "kinh tom", "buc", "ngay", "ac"),
}
# Fixed value: addresses of single videos.
VIDEO_URL = r"^(https?://)?(www\.)?(youtube|youtu|youtube-nocookie)\.(com|be)/(watch\?v=|embed/|v/|.+\?v=)?([^&=%\?]{11})"
# Escapes of a JSON string.
JSON_ESCAPES = {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}


def word_count(c: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda w: w != ""))


def one_spaced(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"^\s+|\s+$", ""), r"\s+", " ")


def strip_accents(c: Column) -> Column:
    """c in lower case without marks on its letters, of any script."""
    return F.translate(F.lower(c), _MARKED, _BARE)


def strip_fence(c: Column) -> Column:
    """Text without a Markdown fence around it."""
    t = F.trim(c)
    return F.when(t.startswith("```"), F.regexp_replace(F.regexp_replace(t, r"^```(?:json)?\s*", ""), r"\s*```$", "")).otherwise(t)


def effective_label(user: Column, predicted: Column, default: str | None = "unlabeled") -> Column:
    """The user's label, else the predicted one; '' counts as missing."""
    found = F.coalesce(F.nullif(user, F.lit("")), F.nullif(predicted, F.lit("")))
    return F.coalesce(found, F.lit(default)) if default is not None else found


def label_source(status: Column, user: Column, predicted: Column) -> Column:
    human = F.coalesce(user, F.lit("")) != ""
    return (
        F.when(human & (user == F.coalesce(predicted, F.lit(""))), "human_verified").when(human, "human_corrected").when(F.coalesce(status, F.lit("")) == "auto_approved", "ai_auto").otherwise("ai_suggested")
    )


def map_emotion(label: Column) -> Column:
    """The first emotion whose mark is in the label."""
    low = F.lower(F.coalesce(label, F.lit("")))
    has = lambda *marks: F.exists(F.array(*(F.lit(m) for m in marks)), lambda m: F.contains(low, m))
    return (
        F.when(has("happy", "joy", "happiness"), "happy").when(has("sad"), "sad").when(has("ang"), "angry").when(has("fear"), "fear").when(has("sur"), "surprise").when(has("dis"), "disgust").otherwise("neutral")
    )


def sentiment(label: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in SENTIMENT.items() for x in kv)), label)


def source_type(url: Column) -> Column:
    host = F.coalesce(F.lower(F.try_parse_url(url, F.lit("HOST"))), F.lit(""))
    marks = (("youtube", "youtube"), ("youtu.be", "youtube"), ("drive.google", "drive"), ("tiktok", "tiktok"), ("facebook", "facebook"), ("fb.watch", "facebook"), ("dailymotion", "dailymotion"))
    out = F.when(F.lit(False), "")
    for mark, name in marks:
        out = out.when(F.contains(host, F.lit(mark)), name)
    return out.otherwise("url")


def is_video_url(url: Column) -> Column:
    return F.coalesce((url != "") & (url.rlike(VIDEO_URL) | url.startswith("http")), F.lit(False))


def safe_name(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(F.nullif(c, F.lit("")), F.lit("unknown")), r"[^\p{L}\p{N}_-]", "_")


def clock(ms: Column) -> Column:
    """mm:ss of milliseconds."""
    s = F.floor(ms / 1000)
    return F.concat(F.lpad(F.floor(s / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((s % 60).cast("string"), 2, "0"))


def size_text(n: Column) -> Column:
    """Bytes as GB, MB or KB with one digit; KB for what is smaller."""
    unit = lambda power, name: F.concat(fixed(n.cast("double") / float(1024**power), 1), F.lit(f" {name}"))
    return F.when(n >= 1024**3, unit(3, "GB")).when(n >= 1024**2, unit(2, "MB")).when(n.isNotNull(), unit(1, "KB"))


def truncated(c: Column, n: int) -> Column:
    """The first n characters."""
    return F.substring(c, 1, n)


def lexicon_hits(text: Column) -> dict[str, Column]:
    """Emotion -> score of the phrases (of three letters or more) found: 1 and 0.15 for each word of the phrase, 2 at most."""
    return _hits(strip_accents(F.trim(text)))


def _hits(low: Column) -> dict[str, Column]:
    """lexicon_hits() of a text in lower case without marks."""
    weigh = lambda p: 1.0 + min(1.0, 0.15 * len(p.split()))
    out = {}
    for emotion, phrases in LEXICON.items():
        hits = [F.when(F.contains(low, F.lit(p)), weigh(p)).otherwise(0.0) for p in phrases if len(p) >= 3]
        out[emotion] = sum(hits[1:], hits[0])
    return out


def _emotion_shares(found: dict[str, Column]) -> dict[str, Column]:
    total = sum(list(found.values())[1:], next(iter(found.values())))
    parts = {**found, "neutral": F.lit(0.25)}
    return {emotion: F.when(total > 0, parts[emotion] / (total + 0.25)) for emotion in EMOTIONS}


def lexicon_scores(text: Column) -> dict[str, Column]:
    """Emotion -> share of lexicon_hits, to which 0.25 for neutral comes if there is any hit; nulls without one."""
    return _emotion_shares(lexicon_hits(text))


def with_lexicon_scores(df: DataFrame, text: str) -> DataFrame:
    """df without the text, with lexicon_scores() of it: a text is bared once and searched once for each phrase, however many scores there are."""
    rest = [x for x in df.columns if x != text]
    bare = df.select(*rest, strip_accents(F.trim(F.col(text))).alias("__low"))
    hits = bare.select(*rest, *(v.alias(f"__{k}") for k, v in _hits(F.col("__low")).items()))
    return hits.select(*rest, *(v.alias(k) for k, v in _emotion_shares({k: F.col(f"__{k}") for k in LEXICON}).items()))


def json_string(c: Column) -> Column:
    """c as a JSON string in ASCII, quotes included."""
    hexed = lambda ch: F.lower(F.hex(F.encode(ch, "UTF-16BE")))
    escapes = F.create_map(*(F.lit(x) for kv in JSON_ESCAPES.items() for x in kv))

    def one(ch: Column) -> Column:
        unit = F.concat(F.lit("\\u"), F.substring(hexed(ch), 1, 4))
        pair = F.when(F.length(hexed(ch)) > 4, F.concat(unit, F.lit("\\u"), F.substring(hexed(ch), 5, 4))).otherwise(unit)
        return F.coalesce(F.try_element_at(escapes, ch), F.when(ch.rlike(r"^[\x20-\x7E]$"), ch).otherwise(pair))

    plain = c.rlike(r'^[\x20\x21\x23-\x5B\x5D-\x7E]*$')
    return F.concat(F.lit('"'), F.when(plain, c).otherwise(F.array_join(F.transform(F.split(c, ""), one), "")), F.lit('"'))


def cache_key(path: Column, stage: Column, prompt: Column, params: Column) -> Column:
    """The key of a cached response: a hash of the JSON list of path, stage, and short hashes of prompt and params (JSON text with sorted keys)."""
    short = lambda c: F.substring(F.sha2(c, 256), 1, 16)
    listed = F.concat(F.lit("["), F.concat_ws(", ", json_string(path), json_string(stage), json_string(short(prompt)), json_string(short(params))), F.lit("]"))
    return F.substring(F.sha2(listed, 256), 1, 32)


def hash_rank(c: Column, seed: str = "") -> Column:
    """An unsigned 32-bit number from md5: the same in every engine."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed), c.cast("string"))), 1, 8), 16, 10).cast("bigint")


# Names of statuses as shown.
STATUS_NAMES = {"pending": "Chờ xử lý", "processing": "Đang xử lý", "completed": "Hoàn thành", "error": "Lỗi", "cancelled": "Đã hủy"}

# What failed downloads say (each inner list: all of these), and the advice given.
DOWNLOAD_ERRORS = (
    ((("http error 403",), ("forbidden",)), "YouTube từ chối truy cập (403). Hãy thử bật cookies trình duyệt, dùng cookies.txt hoặc chuyển sang chế độ tải an toàn."),
    ((("http error 429",), ("too many requests",)), "YouTube tạm chặn do quá nhiều yêu cầu (429). Hãy chờ vài phút, đổi mạng hoặc bật cookies rồi thử lại."),
    ((("sign in to confirm your age",), ("age-restricted",)), "Video yêu cầu đăng nhập hoặc xác minh độ tuổi. Hãy cấu hình cookies trình duyệt hoặc cookies.txt trong Cài đặt."),
    ((("requested format is not available",),), "Không tìm thấy định dạng video phù hợp. Hãy giảm độ phân giải tối đa hoặc thử lại với chế độ tải an toàn."),
    ((("ffmpeg", "not found"),), "Không tìm thấy FFmpeg. Hãy cài FFmpeg hoặc cấu hình đúng đường dẫn trong Cài đặt."),
    ((("signature",), ("cipher",), ("nsig",)), "YouTube thay đổi cơ chế chữ ký phát video. Hãy cập nhật yt-dlp và cân nhắc cài Deno rồi thử lại."),
    ((("cookies", "invalid"), ("cookies", "expired")), "Cookies không hợp lệ hoặc đã hết hạn. Hãy xuất lại cookies.txt hoặc chọn lại trình duyệt lấy cookies."),
    ((("unable to download webpage",), ("timed out",), ("connection",)), "Lỗi kết nối mạng khi truy cập nguồn video. Hãy kiểm tra Internet hoặc thử lại với chế độ tải an toàn."),
)
OTHER_ERROR, NO_ERROR_TEXT = "Lỗi tải video: ", "Không rõ lỗi"


def status_name(status: Column) -> Column:
    names = F.create_map(*(F.lit(x) for kv in STATUS_NAMES.items() for x in kv))
    return F.coalesce(F.try_element_at(names, status), status)


def download_error(message: Column) -> Column:
    """Advice for a failed download, by the first rule whose words its message has."""
    message = F.coalesce(F.nullif(message, F.lit("")), F.lit(NO_ERROR_TEXT))
    low, out = F.lower(message), F.when(F.lit(False), "")
    for rules, advice in DOWNLOAD_ERRORS:
        has = [reduce(Column.__and__, (F.contains(low, F.lit(w)) for w in words)) for words in rules]
        out = out.when(reduce(Column.__or__, has), advice)
    return out.otherwise(F.concat(F.lit(OTHER_ERROR), message))


def iso_time(micros: Column) -> Column:
    """Microseconds since 1970 as ISO 8601 in UTC; a part of a second is shown, with six digits, if there is one."""
    seconds, rest = F.floor(micros / 1_000_000), F.pmod(micros, F.lit(1_000_000))
    whole = F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss")
    return F.when(rest == 0, whole).otherwise(F.concat(whole, F.lit("."), F.lpad(rest.cast("string"), 6, "0")))


def stamp(micros: Column) -> Column:
    """Microseconds since 1970 as part of a file's name: day and time in UTC."""
    return F.date_format(F.timestamp_seconds(F.floor(micros / 1_000_000)), "yyyyMMdd_HHmmss")
