"""Problem 6: template residue, filler and messages in place of content.

Every line of every record's main body (without code) is masked -- numbers, addresses, paths, dates -- and hashed; equal hashes
are grouped across sources, counting sites, records, and records of which the line is the main part. A line that recurs over
several sites and mostly is the main part of its record stands in place of content: it is a message if the phrase rules know
any of its forms, or if it is brief and recurs over many sites, whatever it says. A record whose content is made of such lines
is one. Lines that no group knows are judged by phrases that are messages by themselves; placeholders and filler are told by rules of form.

The project's renderer is not needed: a demand for scripts in place of content is one whichever renderer fetched it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.llm.common import HOT_ROWS, join_hot, site_of
from docspark.llm.neardup import record_bodies
from docspark.llm.stage import slices, written

#: A line of this weight (characters, Chinese ones three times) beside a message makes the body one of its own; so do smaller
#: lines of more than OWN_MOST together.
SMALL, OWN_MOST = 60, 200
#: Sites over which a masked line recurs, and without any phrase; the share of a record's weight that makes a line its main
#: part; the share of a line's records in which it is that.
SITES, SURE_SITES, MAIN_PART, MAIN_SHARE = 3, 4, 0.3, 0.6
#: A line that no group knows by a phrase is a message only up to this weight: a longer one is text.
BRIEF = 170

# Forms of unfilled fields. A strong form is residue wherever it stands outside code, a weak one in a
# heading, with a name of several parts or in capitals, or twice.
_FIELD = r"[A-Za-z][\w.]*(?:[ _][\w.]+)*"
_STRONG = re.compile(
    rf"\{{\{{\s*{_FIELD}\s*(?:\|[^{{}}]*)?\}}\}}|<%=?\s*{_FIELD}\s*%>|\{{%\s*\w[^%]*%\}}|\$\{{\s*{_FIELD}\s*\}}|#\{{\s*{_FIELD}\s*\}}|@@{_FIELD}@@"
    rf"|\[(?:INSERT|ADD|YOUR|ENTER)\s[A-Z .]+\]|\*\|[A-Z_]+\|\*"
)
_WEAK = re.compile(r"\[\[[a-z][a-z_.]*\]\]|(?<![\w{$#])\{[a-z][a-z_.]*\}(?!\})|%[A-Z][A-Z_.]+%|\b__[A-Z][A-Z_.]+__")
_CODE = re.compile(r"`[^`\n]*`")
# Words of the Latin filler text, and phrases of fill-in texts.
_LATIN = frozenset(
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam "
    "quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu "
    "fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum porta vivamus "
    "tellus lectus vestibulum vitae mauris viverra curabitur pellentesque".split()
)
# Of these, words of living languages: they alone do not make a line filler.
_LIVING = frozenset("do in id et est ex non sit ad ut eu ea sed qui quis esse porta culpa labore magna nulla ea dolor".split())
_ONLY_FILLER = _LATIN - _LIVING
# Each with a literal part: a text (in lower case) without any of these cannot match.
_FILLS = (
    ("placeholder", r"\bplaceholder\b"), ("dummy", r"\bdummy (?:text|content|copy)"), ("filler text", r"\bfiller text"), ("here", r"\byour (?:text|content|headline|title|copy) (?:goes )?here"),
    ("text goes here", r"\btext goes here"), ("type here to", r"\btype here to"), ("write something about", r"\bwrite something about"), ("replace this", r"\breplace this (?:paragraph|text)"),
    ("short description of", r"\bshort description of the item"), ("todo: ", r"\bTODO: "),
    ("sample ", r"\bsample (?:heading|copy|text|paragraph)"), ("here", r"\badd (?:your|a) (?:text|description) here"), ("platzhalter", r"\bplatzhalter"), ("blindtext", r"\bblindtext"),
    ("hier steht", r"\bhier steht (?:später )?ihr text"), ("texte ", r"\btexte (?:factice|d.exemple|de remplissage)"), ("votre texte ici", r"\bvotre texte ici"),
    ("texto de ", r"\btexto de (?:ejemplo|relleno|exemplo|preenchimento)"), (" texto aqu", r"\b(?:su|seu|tu) texto aqu[ií]"), ("заполнитель", r"текст-заполнитель"), ("здесь будет", r"здесь будет (?:ваш )?текст"),
    ("рыбный текст", r"рыбный текст"), ("tekst zastępczy", r"tekst zastępczy"), ("tekst", r"tu (?:wpisz|wstaw) tekst"), ("占位", r"占位"), ("示例文", r"示例文字|示例文本"), ("此处填写", r"此处填写"), ("在此输入", r"在此输入"),
    ("这里是正文", r"这里是正文"), ("请在此处", r"请在此处"),
)
_FILL = re.compile("(?i)" + "|".join(p for _, p in _FILLS))
_FILL_KEYS = tuple(dict.fromkeys(k for k, _ in _FILLS))
# Phrases of messages.
_MESSAGE = re.compile(
    r"(?i)\bjava ?script\b|\bscripts? (?:switched|to work|enabled|are (?:off|required))|needs scripts|newer browser|"
    r"启用.{0,6}脚本|脚本|不存在|无法(?:访问|显示|找到)|找不到|加载|稍候|拒绝访问|访问被拒|请求过多|出错|服务器|维护|"
    r"\b(?:http )?[45]0\d\b|\b[45]\d\d (?:[A-Z][a-z-]+|error)|\bnot found\b|introuvable|no se encuentra|nicht gefunden|não (?:foi )?encontrad|не найден|nie (?:została )?znalezion|"
    r"never existed|nothing (?:here|lives)|can.t find the page|file missing|page (?:is )?(?:gone|missing)|(?:moved|removed) or|"
    r"access denied|was blocked|\bforbidden\b|not a robot|captcha|too many requests|session (?:has )?expired|sign in again|permission to|accès refusé|acceso denegado|"
    r"zugriff verweigert|доступ запрещ|odmowa dostępu|acesso negado|fatal error|uncaught|unhandled|exception|stack trace|database connection|service unavailable|"
    r"server error|time-?out|maintenance|temporarily|try again later|\bloading\b|please wait|bitte warten|lädt|chargement|cargando|carregando|загрузка|подождите|wczytywanie|"
    r"ładowanie|aktivieren sie|activez|active javascript|habilit[ae]|ative o|включите|włącz|mantenimiento|manutenção|wartung|obsługi"
)
# What is a message by itself, wherever it makes up the body; the other phrases are only votes on a line that recurs.
_SURE = re.compile(
    r"(?i)(?:enable|turn on|activez|aktivieren sie|habilit[ae]|ative|включите|włącz)\b.{0,12}java ?script|java ?script (?:is|must be) |启用.{0,6}脚本|^\W*(?:http |error )?[45]\d\d\b.{0,40}$|"
    r"\b(?:page|site) not found\b|(?:can.t|cannot) find the page|(?:moved|removed) or never existed|introuvable|no se encuentra|nicht gefunden|页面不存在|access denied|accès refusé|acceso denegado|访问被拒|拒绝访问|not a robot|captcha|too many requests|"
    r"fatal error|uncaught|unhandled|stack trace|database connection|service unavailable|session (?:has )?expired|^\W*(?:loading|please wait|bitte warten|加载中)\b.{0,20}$"
)
# What is masked, each with signs without which it cannot stand in a line.
_MASKS = (
    (("://", "www."), re.compile(r"https?://\S+|www\.\S+"), "\x00u"), (("@",), re.compile(r"[^\s@]+@[^\s@]+\.\w+"), "\x00e"), (("/",), re.compile(r"(?:/[\w.-]+){2,}"), "\x00p"),
    (tuple("0123456789"), re.compile(r"\b(?=[a-f]*\d)[0-9a-f]{8,}\b"), "\x00h"), (tuple("0123456789"), re.compile(r"\d+(?:[.:,/-]\d+)*"), "\x00n"), (tuple("*_#>`"), re.compile(r"[*_#>`]+"), " "),
)
_CJK = re.compile(r"[㐀-鿿]")
_STRONG_KEYS = ("{{", "<%", "{%", "${", "#{", "@@", "[insert", "[add", "[your", "[enter", "*|")
_WEAK_KEYS = ("[[", "{", "%", "__")
_NAME = re.compile(r"[^\W\d_]+")


def masked(line: str) -> str:
    """The line in lower case, without Markdown's marks, with numbers, addresses, paths and dates as one sign each."""
    line = line.lower()
    for signs, pattern, by in _MASKS:
        for sign in signs:
            if sign in line:
                line = pattern.sub(by, line)
                break
    return " ".join(line.split())


def weight(text: str) -> int:
    return len(text) + 2 * len(_CJK.findall(text))


def is_filler(line: str, low: str | None = None) -> bool:
    """Latin filler (most words of a line of five and more, one of no living language), or the phrases of fill-in texts over most of the line."""
    low = line.lower() if low is None else low
    words = _NAME.findall(low)
    if len(words) >= 5 and sum(w in _LATIN for w in words) >= 0.75 * len(words) and not _ONLY_FILLER.isdisjoint(words):
        return True
    if not any(k in low for k in _FILL_KEYS):
        return False
    sentences = [x for x in re.split(r"(?<=[.!?。！？])\s*", line) if x.strip()]
    return bool(sentences) and sum(weight(x) for x in sentences if _FILL.search(x)) >= 0.5 * sum(map(weight, sentences))


def _form(title: str, heads: str, prose: str) -> tuple[int, int, int, int, dict[int, tuple[int, int]]]:
    """``strong, weak, total, filler, units`` of a record: fields, weights, and for the key of each of its lines the weight and
    how far a phrase knows it: 2 surely, 1 as a vote. A record of headings alone has these as its lines."""
    from xxhash import xxh64_intdigest

    plain = _CODE.sub(" ", prose) if "`" in prose else prose
    above = _CODE.sub(" ", title + "\n" + heads)
    low = (above + "\n" + plain).lower()
    strong = weak = 0
    if any(k in low for k in _STRONG_KEYS):
        strong = len(_STRONG.findall(plain)) + len(_STRONG.findall(above))
    if any(k in low for k in _WEAK_KEYS):
        weak = sum(2 if re.search(r"[A-Z_.]", x.strip("_")) else 1 for x in _WEAK.findall(plain)) + 2 * len(_WEAK.findall(above))
    # words parted by white space, commas and full stops show whether any line may be Latin filler
    fills = not _ONLY_FILLER.isdisjoint(low.replace(",", " ").replace(".", " ").split()) or any(k in low for k in _FILL_KEYS)
    names = {title.strip().lower(), *(h.strip().lower() for h in heads.split("\n"))}
    lines, total, filler, flow = [], 0, 0, False
    for line in plain.split("\n"):
        line = line.strip()
        small = line.lower()
        if not line or small in names:
            continue
        w = len(line) if line.isascii() else weight(line)
        total += w
        lines.append((line, w))
        if fills:
            whole = is_filler(line, small)
            # the end of a wrapped paragraph of filler counts with it
            if whole or flow and len(_NAME.findall(small)) < 5 and any(x in _LATIN for x in _NAME.findall(small)):
                filler += w
            flow = whole
    if not lines:
        lines = [(h.strip(), weight(h.strip())) for h in heads.split("\n") if h.strip()]
        total = sum(w for _, w in lines)
    bare = all(w <= BRIEF for _, w in lines)  # otherwise the record has text, and no phrase alone makes it a message
    units: dict[int, tuple[int, int]] = {}
    for line, w in lines:
        key = xxh64_intdigest(masked(line)) - 2**63
        before, said = units.get(key, (0, 0))
        if bare and not said:
            said = 2 if _SURE.search(line) else 1 if _MESSAGE.search(line) else 0
        units[key] = before + w, said
    return strong, weak, total, filler, units


_UNIT = pa.struct([("key", pa.int64()), ("weight", pa.int32()), ("said", pa.int8())])
FEATURES = "site string, strong int, weak int, total int, filler int, units array<struct<key:long,weight:int,said:tinyint>>"


def _features(id_type: pa.DataType):
    names = ["seq", "site", "strong", "weak", "total", "filler", "units"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            forms = [_form(t or "", h or "", p or "") for t, h, p in zip(*(batch.column(c).to_pylist() for c in ("title", "heads", "prose")))]
            first = [pa.array([f[i] for f in forms], pa.int32()) for i in range(4)]
            keys, weights, said = [k for f in forms for k in f[4]], [w for f in forms for w, _ in f[4].values()], [x for f in forms for _, x in f[4].values()]
            starts = [0]
            for f in forms:
                starts.append(starts[-1] + len(f[4]))
            units = pa.StructArray.from_arrays([pa.array(keys, pa.int64()), pa.array(weights, pa.int32()), pa.array(said, pa.int8())], fields=list(_UNIT))
            yield pa.RecordBatch.from_arrays([batch.column("seq").cast(id_type), batch.column("site"), *first, pa.ListArray.from_arrays(pa.array(starts, pa.int32()), units)], names=names)

    return run


def residue(df: DataFrame, config: DataFrame) -> DataFrame:
    """``seq, kind`` of the records to leave out; kind is ``template``, ``filler`` or ``message``.

    ``df`` has ``seq`` (unique), ``raw_text, title, source_url, media_type, project_id``; further columns are not read. Null
    and empty records, records with a short body of their own, and records that only show or discuss such things (in code, or
    within longer text) give no row; an empty table gives none.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    of = df.schema["seq"].dataType
    site = F.coalesce(site_of(F.col("source_url")), F.concat(F.lit("project "), F.col("project_id").cast("string")), F.lit(""))
    bodies = record_bodies(df, config, ("heads", "prose")).join(df.select("seq", "title", site.alias("site")), "seq")
    found = written(bodies.mapInArrow(_features(to_arrow_type(of)), f"seq {of.simpleString()}, {FEATURES}"))
    lines = found.select("seq", F.xxhash64("site").alias("site"), "total", F.explode("units").alias("u")).select("seq", "site", "total", "u.key", "u.weight", "u.said")
    main = F.col("weight") >= MAIN_PART * F.col("total")
    groups = lines.groupBy("key", "site").agg(F.count(F.lit(1)).alias("n"), F.count_if(main).alias("main"), F.max("weight").alias("weight"), F.max("said").alias("known"))
    groups = groups.groupBy("key").agg(F.count(F.lit(1)).alias("sites"), F.sum("n").alias("n"), F.sum("main").alias("main"), F.max("weight").alias("weight"), F.max("known").alias("known"))
    messages = written(groups.filter((F.col("sites") >= SITES) & (F.col("main") >= MAIN_SHARE * F.col("n")) & (
        (F.col("known") > 0) | (F.col("sites") >= SURE_SITES) & (F.col("weight") <= BRIEF))).select("key", "n", F.lit(True).alias("wide")))
    judged = join_hot(lines, messages.drop("n"), ["key"], messages.filter(F.col("n") > HOT_ROWS), "seq", "left").withColumn("message", (F.col("said") == 2) | F.coalesce("wide", F.lit(False)))
    judged = judged.groupBy("seq").agg(
        F.count_if("message").alias("messages"), F.max(F.when(~F.col("message"), F.col("weight"))).alias("largest"), F.sum(F.when(~F.col("message"), F.col("weight"))).alias("own"))
    message = (F.col("messages") > 0) & (F.coalesce("largest", F.lit(0)) < SMALL) & (F.coalesce("own", F.lit(0)) <= OWN_MOST)
    return found.join(judged.filter(message).select("seq", F.lit(True).alias("stands")), "seq", "left").select("seq", F.when(
        (F.col("strong") > 0) | (F.col("weak") >= 2), "template").when(
        (F.col("filler") >= 0.4 * F.col("total")) & (F.col("filler") > 0) | (F.col("filler") >= 150) & (F.col("filler") >= 0.2 * F.col("total")), "filler").when(
        F.col("stands"), "message").alias("kind")).filter("kind is not null")
