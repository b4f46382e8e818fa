"""Template residue and error-page text.

Records made from one template are aligned line by line: what all have in common is the template's
skeleton, what varies is a slot.  A slot that still holds a variable's name, a default or nothing was
left unfilled.  A name in a template language's own delimiters shows a slot in a single record; text
that only looks like a default counts where the skeleton is known from other records, whose slots
hold such names or are filled: a sentence with a value that looks unfilled is aligned with the sentences of
all records, and what they have in its place shows whether there is a slot.  Quotes and code are no
running text and are taken out before.

Pages without content are found by their whole body: heading and page furniture are taken off, and every
sentence of the rest has to be a page's.  Few are by themselves (standing phrases of servers, notices
about scripts, filler).  Others only might be: these are aligned with the sentences of all such texts, one or two
words as a slot, and count where the corpus has them over and over with other words there, or beside a
sure one.  Furniture, and whatever else pages say, is learned from the pages that have it beside such sentences.
"""

from __future__ import annotations

import hashlib
import html
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepwright.session import cut_lineage, document_batches, written

# parts are told apart by what can't be in them, and bounded, so that no text makes the search slow
_NAME = r"[^\W\d_]\w{0,60}(?:[ \t]{0,3}[.\-][ \t]{0,3}\w{1,60}|[ \t]{1,3}\w{1,60}){0,8}"
#: Delimiters by which template languages mark a variable.
SLOT_FORMS = (
    r"\{\{-?\s*" + _NAME + r"\s*-?\}\}", r"\{%-?\s*" + _NAME + r"\s*-?%\}", r"\$\{\s*" + _NAME + r"\s*\}", r"\$\(\s*" + _NAME + r"\s*\)",
    r"<%[=\-]?\s*" + _NAME + r"\s*-?%>", r"#\{\s*" + _NAME + r"\s*\}", r"\[\[\s*" + _NAME + r"\s*\]\]", r"<<\s*" + _NAME + r"\s*>>",
    r"@@(?=\w{1,60}?[-_.])[\w.\-]{2,80}@@", r"##(?=\w{1,60}?[-_.])[\w.\-]{2,80}##", r"(?<![\w_])__[A-Za-z]{1,40}(?:_[A-Za-z]{1,40}){1,8}__(?![\w_])", r"(?<![\w%])%[A-Za-z]{1,40}_[A-Za-z_]{1,60}%(?![\w%])", r"%\(\w{1,80}\)[sd]",
    r"\[(?:insert|enter|add|put|fill in|type)\s[^\[\]\n]{1,80}\]", r"\[your\s[^\[\]\n]{1,80}\]", r"<\s*(?:your|insert|enter)\s[^<>\n]{1,80}>",
    r"\((?:write|insert|enter|fill in|put|type|add)\s(?:the|your|a|an)\s[^()\n]{1,80}\)",
)
#: Texts that stand for an empty slot where the skeleton is known.
DEFAULTS = r"(?:undefined|null|none|nan|n/a|tbd|todo|xxx+|\[object object\]|_{3,}|\.{3,}|…)"
_SLOT = re.compile("|".join(f"(?:{f})" for f in SLOT_FORMS), re.I)
# a text without any of these has no slot; most texts end here
_HINT = re.compile(
    r"(?im)\{\{|\{%|[$#]\{|\$\(|<%|\[\[|<<|@@|##\w|__[a-z]|%\(|%[a-z]{1,40}_|\[(?:insert|enter|add|put|fill|type|your)\s|<\s*(?:your|insert|enter)\s|\((?:write|insert|enter|fill|put|type|add)\s"
    rf"|(?<![\w.]){DEFAULTS}(?![\w.])|^.{{0,60}}\w[:,][ \t]*$")
_DEFAULT = re.compile(rf"(?<![\w.]){DEFAULTS}(?![\w.])", re.I)
_FENCE = re.compile(r"(?ms)^[ \t>]*(```+|~~~+)[^\n]*$.*?(?:^[ \t>]*\1[^\n]*$|\Z)|<(pre|code)\b(?:(?!<(?:pre|code)\b).)*?</\2>")
_INLINE = re.compile(r"(`+)[^`]+?\1|\"[^\"\n]+\"|“[^“”\n]+”|„[^„“”\n]+[“”]|«(?!\s*\w{1,60}[._]\w{1,60}\s*»)[^«»\n]+»|「[^「」\n]+」|(?<!\w)'[^'\n]{2,}'(?!\w)")
_CODE_LINE = re.compile(r"^\s*(?:\$ |>>> |\.\.\. |#!|(?:def|class|return|import|from|if|for|while|with|select|insert|update) .*[:;(=]|[\w.\-/]+:\d+:)|^(?: {4}|\t)\S|^\s*[\w.]+\([^)]*\)\s*$")
_TAG = re.compile(r"(?is)<!--(?:(?!<!--).)*?-->|<(style|script)\b(?:(?!<(?:style|script)\b).)*?</\1>|</?[a-z][a-z0-9]*\b[^<>\n]*+(?:\n(?!\s*\n)[^<>\n]*+)*+>|<!doctype[^<>]*>")
_SENTENCE = re.compile(r"\n+|(?<=[.!?…])[)\"'”]*\s+|(?<=[。！？])|\s*[|]\s*")
_PAGE_SENTENCE = re.compile(r"(?<=[.!?…])[)\"'”]*\s+|(?<=[。！？])|\s*[|·•]\s*|(?=[©«])|(?<=»)")
_MASK = re.compile(r"\b(?=\w*\d)[0-9a-f]{2,}\b|\d+", re.I)

FILLER_WORDS_SHARE = 0.8


@lru_cache(maxsize=1)
def _running(text: str) -> str:
    """``text`` in compatible characters, as running text: code taken out, a \\x02 for each quotation."""
    text = unicodedata.normalize("NFKC", text.replace("\r\n", "\n").replace("\r", "\n"))
    return _INLINE.sub("\x02", _FENCE.sub("\n", text))


def plain(text: str) -> str:
    """``text`` in compatible characters, as running text: code and quotes taken out, tags as line breaks."""
    return _running(text).replace("\x02", " ")


def slots(text: str) -> list[tuple[bool, str, str]]:
    """(sure, skeleton, value) of the slots of a text's lines that look unfilled.

    The skeleton is the line's words with a mark for each slot; of a slot that fills its line, the line
    before it.  A default, or nothing between a greeting or label and its mark, is not sure.
    """
    found, before = [], ""
    if not _HINT.search(unicodedata.normalize("NFKC", text.replace("\r\n", "\n").replace("\r", "\n"))):
        return found
    for line in plain(text).split("\n"):
        bare = line.strip()
        if not bare:
            continue
        if _CODE_LINE.match(line):
            before = bare
            continue
        for pattern, sure in ((_SLOT, True), (_DEFAULT, False)):
            values = pattern.findall(bare) and [m.group(0) for m in pattern.finditer(bare)]
            if values:
                skeleton = re.sub(r"\W*\x00\W*", " \x00 ", pattern.sub("\x00", bare)).strip()
                skeleton = f"{before} {skeleton}" if skeleton == "\x00" else skeleton
                found += [(sure, _MASK.sub("0", skeleton.lower()), v.lower()) for v in values]
                break
        else:
            blank = re.match(r"^(.{0,30}?\w)(:|,)$", bare) and re.sub(r"\W+$", "", bare)
            if blank and len(blank.split()) <= 2:
                found.append((False, f"{blank.lower()} \x00", ""))
        before = bare
    return found


#: Any pair of marks that is no ordinary punctuation, a name in capitals with underscores, or nothing before a comma
#: or full stop: values that count where filled records show the slot, beside DEFAULTS and blank labels.
_MARKS = r"[^\w\s.,;:!?'\"()*`/\\=\-–—|·•\x00-\x02]{1,3}"
_UNFILLED = re.compile(
    rf"(?<!\w)(?P<open>{_MARKS})[ \t]{{0,3}}[^\W\d_]\w{{1,60}}(?:[ \t.\-]\w{{1,60}}){{0,2}}[ \t]{{0,3}}(?P<close>{_MARKS})(?![\w(\[])|(?<!\w)[A-Z]{{2,40}}(?:_[A-Z]{{2,40}}){{1,8}}(?!\w)"
    rf"|(?<![\w.])(?i:{DEFAULTS})(?![\w.])|(?<=\w)[ \t]{{1,4}}(?=[,.](?:\s|$))")
# most texts have none of these and end here
_OPEN_HINTS = (re.compile(r"[A-Z]_[A-Z]"), re.compile(r"[ \t][,.](?:\s|$)"), re.compile(rf"(?<!\w){_MARKS}[ \t]{{0,3}}[^\W\d_]\w{{1,60}}(?:[ \t.\-]\w{{1,60}}){{0,2}}[ \t]{{0,3}}{_MARKS}(?![\w(\[])"), re.compile(rf"(?i)(?<![\w.]){DEFAULTS}(?![\w.])"))
_LABEL = re.compile(r"^[^\W\d_](?:[^\n:]{0,30}\w)?:(?:\s|$)")
_BLANK_LABEL = re.compile(r"(?m)^[ \t>*+\-]*[^\W\d_](?:[^\n:]{0,30}\w)?:[ \t]*\r?$(?=\s*(?:\Z|#|[^\W\d_](?:[^\n:]{0,30}\w)?:(?:\s|$)))")
_MIRROR = str.maketrans("[{<«《【", "]}>»》】")
_TOKEN = re.compile(r"\w+|[\x00-\x02:,]")
_HTML = re.compile(r"(?i)<\s*(?:html|head|body|title|main|nav|header|footer|section|article|noscript|script|style|div|span|table|tr|td|th|ul|ol|li|dl|dt|dd|br|hr|em|strong|code|pre|small|center|blockquote|details|summary|kbd|sub|sup|h\d)\s*>")

#: A slot is known from filled records if so many have a value in its place, with so many values among them, or the same value in
#: SLOT_SAME of them; a slot inside a sentence has SLOT_WORDS words beside it, unless a colon or comma marks it. Skeletons are
#: broadcast, so many a pass.
SLOT_RECORDS, SLOT_VALUES, SLOT_SAME, SLOT_WORDS, SKELETONS_A_PASS = 3, 2, 10, 4, 100_000


def _tokens(text: str) -> list[str]:
    return _TOKEN.findall(text.lower())


def _pieces(text: str, opened: bool = False) -> Iterator[str]:
    """The sentences of a text's running lines; one that fills a line has the line before it, and a label the line behind it.

    A quotation is a \\x02; \\x01 stands behind the line before, \\x00 where a label is blank.  With ``opened``, of lines
    that may have a value left open only.
    """
    lines = [(x, x.strip()) for x in _running(text).split("\n") if x.strip()]
    for i, (line, bare) in enumerate(lines):
        if (opened and not bare.endswith(":") and not _UNFILLED.search(bare)) or _CODE_LINE.match(line):
            continue
        parts = [p for p in _SENTENCE.split(bare) if p and p.strip()]
        yield from parts
        if len(parts) == 1 and i and not _CODE_LINE.match(lines[i - 1][0]):
            before = lines[i - 1][1]
            if not before.endswith(":"):
                yield f"{before} \x01 {bare}"
            elif not _LABEL.match(bare):
                yield f"{before} {bare}"
        if bare.endswith(":") and (i + 1 == len(lines) or _LABEL.match(lines[i + 1][1]) or lines[i + 1][1].startswith("#")):
            yield f"{bare} \x00"


def _opened(piece: str) -> str:
    """A sentence with a mark for each value that looks unfilled."""
    def mark(m: re.Match) -> str:
        if m["open"] is not None and m["open"].translate(_MIRROR)[::-1] != m["close"]:
            return m[0]
        return m[0] if _HTML.match(m[0]) or (piece.isupper() and "_" in m[0]) else " \x00 "

    return _UNFILLED.sub(mark, _SLOT.sub(" \x00 ", piece))


def open_skeletons(text: str) -> list[str]:
    """The skeletons of the sentences in which a value looks unfilled, as far as their words could show a slot."""
    normal = unicodedata.normalize("NFKC", text)
    if not (any(p.search(normal) for p in _OPEN_HINTS) or _BLANK_LABEL.search(normal)):
        return []
    running = _running(text)
    if not (_UNFILLED.search(running) or _BLANK_LABEL.search(running)):
        return []  # values in SLOT_FORMS alone are sure
    found = set()
    for piece in _pieces(text, True):
        opened = _opened(piece)
        if "\x00" not in opened:
            continue
        tokens = [_MASK.sub("0", t) for t in _tokens(opened)]
        if "\x01" in tokens and ("\x00" in tokens[: tokens.index("\x01")] or tokens[tokens.index("\x01") + 1 :] != ["\x00"]):
            continue
        words = sum(t[0].isalpha() for t in tokens)
        marked = all(tokens[i - 1 : i] in ([":"], ["\x01"]) or tokens[i + 1 : i + 2] == [","] for i, t in enumerate(tokens) if t == "\x00")
        if words >= (1 if marked else SLOT_WORDS):
            found.add(" ".join(tokens))
    return sorted(found)


def _aligner(skeletons: list[str]):
    """A function that gives (skeleton, values) of a text's sentences that fill the slots of one of ``skeletons``."""
    by_word: dict[str, list[tuple[frozenset[str], re.Pattern, str]]] = {}
    for k in skeletons:
        words = frozenset(t for t in k.split(" ") if t[0].isalpha())
        gap = r"(\S+(?: \S+){0,7})"
        *inner, last = re.sub(r"\x00(?: \x00)+", "\x00", k).split("\x00")
        pattern = gap.join(map(re.escape, inner)) + (r"(\S+(?: \S+){0,59})" if not last else gap + re.escape(last))
        by_word.setdefault(max(words, key=lambda w: (len(w), w)), []).append((words, re.compile(pattern), k))

    def align(text: str) -> set[tuple[str, str]]:
        seen = set(re.findall(r"\w+", unicodedata.normalize("NFKC", text).lower()))
        open_to = [x for w in by_word.keys() & seen for x in by_word[w] if x[0] <= seen]
        found = set()
        for piece in _pieces(text) if open_to else ():
            if "\x00" in _opened(piece):
                continue
            raw = _tokens(piece)
            masked = " ".join(_MASK.sub("0", t) for t in raw)
            for _, pattern, k in open_to:
                m = pattern.fullmatch(masked)
                if m and not any("\x01" in v for v in m.groups()):
                    at = [(masked.count(" ", 0, m.start(g)), masked.count(" ", 0, m.end(g)) + 1) for g in range(1, len(m.groups()) + 1)]
                    found.add((k, "\n".join(" ".join(raw[a:b]) for a, b in at)))
        return found

    return align


def filled_slots(documents: DataFrame, skeletons: DataFrame, doc_id: str = "doc_id", a_pass: int = SKELETONS_A_PASS) -> DataFrame:
    """The skeletons of ``skeletons`` (skeleton) whose slots are filled in other documents; each pass reads the documents once."""
    passes = -(-skeletons.count() // a_pass)
    spark, kind = documents.sparkSession, documents.schema[doc_id].dataType.simpleString()
    if not passes:
        return skeletons.limit(0)
    document_batches(spark)

    def aligned(known: list[str]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            align = _aligner(known)
            for batch in batches:
                take, rows = [], []
                for i, text in enumerate(batch.column(1).to_pylist()):
                    own = align(text) if text else ()
                    rows += own
                    take += [i] * len(own)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(take, pa.int64())), pa.array([k for k, _ in rows], pa.string()), pa.array([v for _, v in rows], pa.string())], names=[doc_id, "skeleton", "filled"])

        return documents.select(doc_id, "text").mapInArrow(run, f"`{doc_id}` {kind}, skeleton string, filled string")

    part = F.pmod(F.xxhash64("skeleton"), F.lit(passes))
    found = None
    for k in range(passes):
        more = aligned([r.skeleton for r in skeletons.filter(part == k).collect()])
        found = more if found is None else found.unionByName(more)
    counted = found.groupBy("skeleton").agg(F.countDistinct(doc_id).alias("n"), F.countDistinct("filled").alias("values"))
    return counted.filter((F.col("n") >= SLOT_RECORDS) & ((F.col("values") >= SLOT_VALUES) | (F.col("n") >= SLOT_SAME))).select("skeleton")


_CONFUSABLE = str.maketrans("’‘", "''")
#: Words of page furniture; a line of nothing else is taken off. Other furniture is learned.
FURNITURE = frozenset(
    "home projects sign in out menu search help contact status terms privacy back to the login log register about copyright all rights reserved page top next "
    "previous footer header skip content".split()
)
_FURNITURE_LINE = re.compile(r"(?i)^(?:(?:\W*(?:request|reference|trace|error|incident)\b[\s\w]{0,20}?[\W_]*+(?:(?=[a-f-]*+\d)[0-9a-f-]++|[0-9a-f]{4,}+)\W*)+|(?:©|\(c\)|copyright)\s*(?:[^\s.!?]+[ ,]*){1,8}|(?:«\s*)?back to(?: \S+){1,4}|[\W_]*)$")

# What whole sentences of error pages, notices about scripts and filler are, in several languages.
_REASON = r"bad request|unauthori[sz]ed|forbidden|(?:page |file |url )?not found|gone|method not allowed|request time-?out|too many requests|internal (?:server )?error|server error|bad gateway|(?:service )?(?:temporarily |is )?unavailable|gateway time-?out|timed out|access denied|permission denied"
_THING = r"(?:sorry\W+|oops\W+)?(?:the|this|that) (?:requested )?(?:page|site|url|address|file|document|resource|link)\b(?: you (?:asked|were looking|are looking) for| you requested)?"
_JS = r"(?:java ?script|js|(?:client-side )?scripts?|(?:client-side )?scripting)"
ERROR_SENTENCES = (
    rf"(?:http\W*)?(?:error\W*)?[45]\d\d\W+(?:{_REASON})", rf"(?:error\W*)?[45]\d\d\W+{_THING}.*", r"(?:access denied|page not found|bad gateway|too many requests|service (?:is )?(?:temporarily )?unavailable|internal server error|gateway time-?out(?: while (?:contacting|connecting to|waiting for) .*)?)",
    rf"service temporarily unavailable\W.*", r"(?:your|the|this) session (?:has |is |was )?(?:expired|timed out|closed|ended)",
    rf"{_THING} (?:cannot|can't|could not|couldn't) be (?:found|displayed|shown|loaded|opened)(?: or .*)?", rf"{_THING} (?:does not|doesn't|no longer) exists?(?: or .*)?", rf"{_THING} (?:has been|was) (?:moved|removed|deleted)(?: or .*)?", rf"{_THING} is not available",
    r"(?:sorry\W+|oops\W+)?the [\w ]+ (?:you (?:requested|asked for|are looking for)|behind this link|at this address) (?:cannot|can't|could not|couldn't) be (?:found|displayed|shown|loaded|opened)",
    r"(?:sorry\W+|oops\W+)?the [\w ]+ (?:you (?:requested|asked for|are looking for)|behind this link|at this address) (?:(?:does not|doesn't|no longer) exists?|is not available|(?:has been|was) (?:moved|removed|deleted)(?: or .*)?)",
    r"(?:sorry\W+)?you (?:are not (?:allowed|permitted|authori[sz]ed)|do not have (?:permission|access|the rights?)|don't have permission|lack the rights?|must be (?:signed|logged) in|have to (?:sign|log) in|need (?:an account|to (?:sign|log) in|permission)) to (?:see|view|read|open|access|use) this [\w ]+",
    r"we (?:cannot|can't|could not|couldn't) find (?:that|the|this) (?:page|file|document|repository|project|site|address)", r"connection (?:was )?(?:reset|refused|closed)(?: by peer)?",
    r"(?:this|our) [\w ]+ is (?:currently |temporarily )?(?:down|offline|closed) for maintenance\b.*", r"(?:we are )?(?:checking|verifying) (?:that |if |whether )?you are (?:not a robot|human)\b.*",
    r"(?:oops\W+|sorry\W+)?something went wrong(?: on our (?:side|end))?", r"an? (?:internal |unexpected |unknown )?(?:server )?error (?:has )?occurred(?:\W+\w*)?",
    r"(?:erreur [45]\d\d\W+)?(?:page introuvable|page non trouvée)", r"accès refusé(?:\s*[^\w\s].*)?", r"votre session a expiré", r"le service est (?:momentanément |temporairement )?indisponible(?:\s*[^\w\s].*)?",
    r"(?:fehler [45]\d\d\W+)?(?:die )?seite (?:wurde )?nicht gefunden", r"zugriff verweigert(?:\s*[^\w\s].*)?", r"ihre sitzung ist abgelaufen", r"der dienst ist (?:\w+ )?nicht (?:erreichbar|verfügbar)(?:\s*[^\w\s].*)?",
    r"(?:error [45]\d\d\W+)?(?:no se encontró la página|página no encontrada)", r"acceso denegado(?:\s*[^\w\s].*)?", r"su sesión ha (?:caducado|expirado)", r"el servicio no está disponible(?:\s*[^\w\s].*)?(?: por ahora.*)?",
    r"(?:[45]\d\d\W*)?(?:您的|该|此|本)?(?:页面|服务|会话|访问)(?:暂时)?(?:不存在|不可用|已过期|被拒绝|无法显示).*", r"(?:ページ|お探しのページ)が?見つかりません.*",
)
SCRIPT_SENTENCES = (
    rf"(?:please |you (?:need|have|must)(?: to)? )(?:enable|activate|turn on|switch on|allow) {_JS}\b.*", rf"{_JS} (?:is|are) (?:currently )?(?:disabled|blocked|turned off|switched off|off|not enabled|required)(?: in your browser)?(?:,.*)?",
    rf"{_JS} (?:must|has to|needs to|need to|have to) be (?:enabled|on|allowed)(?: in your browser)?(?:\s*[^\w\s].*)?", rf"this [\w ]+? (?:requires?|needs?|relies on|depends on|is built with|does not work without) {_JS}(?:[;,] .*| to (?:work|run|function|load)\b.*)?",
    rf"your browser (?:does not|doesn't) (?:support|run|allow) (?:the )?{_JS}\b.*",
    r"(?:veuillez activer|activez) (?:le )?javascript\b.*", r"cette (?:page|application) ne fonctionne pas sans (?:javascript|scripts)", r"(?:bitte )?aktivieren sie (?:bitte )?javascript\b.*", r"ohne (?:javascript|skripte) kann .*",
    r"(?:por favor\W+)?activ[ea] (?:el )?javascript\b.*", r"esta (?:página|aplicación) necesita (?:javascript|scripts)\b.*", r"请(?:先)?启用 ?javascript.*", r"您的浏览器(?:禁用|不支持)了?(?:脚本|javascript).*",
)
_PART = r"(?:content|text|body|description|title|summary|caption)"
FILLER_SENTENCES = (
    r"lorem ipsum\b.*", rf"(?:your |the )?{_PART} (?:goes|comes) here", rf"(?:your |the )?{_PART} (?:will (?:appear|go|come)|to be (?:added|written|done|filled))\b.*", r"(?:sample|dummy|placeholder|filler) (?:text|body|content|copy)(?:\s*[^\w\s].*| (?:here|only|for)\b.*)?",
    r"(?:nothing to see (?:yet|here)|coming soon|under construction|to be (?:added|done|written))(?:\s*[^\w\s].*)?", r"this (?:page|text|paragraph|section|space) (?:is |was )?(?:only |just |intentionally )?(?:fills?|left blank|here to fill)\b.*", r"此处填写.*|示例文本.*",
)
_SURE = re.compile("|".join(f"(?:{p})" for p in (*ERROR_SENTENCES, *SCRIPT_SENTENCES, *FILLER_SENTENCES)), re.I)
# What sentences of such pages may say. Ordinary sentences do too, so they count beside one of the above, or where
# the corpus has them over and over.
_HINTED = re.compile(
    r"(?i)(?:http\W*)?\b[45]\d\d\s*[:–—-]|\b(?:error|erreur|fehler) [45]\d\d|\b(?:java ?script|js|scripts|scripting|client-side scripts?|skripte|noscript)\b|脚本|スクリプト|скрипт|"
    r"\b(?:not found|no longer exists?|does not exist|(?:cannot|can't|could not|couldn't|can not|can never) (?:find|be (?:displayed|shown|found|loaded|opened|drawn|rendered|reached))|not available|unavailable|did not work|not load|"
    r"(?:been|was|were) (?:moved|removed|deleted)|private or deleted|gateway|time-?out|timed out|forbidden|unauthori[sz]ed|denied|permissions?|rights to|not allowed|signed in|sign in|log ?in|an account|"
    r"session|expired|too many requests|slow down|internal error|went wrong|(?:hit|ran into) a problem|gave up|connection (?:reset|refused|closed)|no valid answer|maintenance|(?:try|retry|reload|back)\b.{0,20}\b(?:again|once more|later)|please retry|"
    r"come back later|reload|refresh|not a robot|upstream|backend|placeholder|dummy|sample text|coming soon|your own words|under construction|fills the space|"
    r"introuvable|indisponible|expiré|refusé|connecter|reconnecter|réessayez|nicht gefunden|nicht erreichbar|abgelaufen|verweigert|anmelden|melden sie sich|später|no se encontró|no está disponible|denegado|caducado|inicie sesión|inténtelo)\b|"
    r"不存在|无法显示|不可用|稍后再试|被拒绝|登录|已过期|已被移动|占位|見つかりません|エラー")


def _is_furniture(line: str) -> bool:
    if _FURNITURE_LINE.match(line):
        return True
    told = re.findall(r"[^\W\d_]+", _MASK.sub(" ", line.lower()))
    return bool(told) and len(told) <= 8 and all(w in FURNITURE for w in told)


_JAVASCRIPT = re.compile(r"(?i)java\s*script")
_IDENTIFIER = re.compile(r"\w_\w|[a-z][A-Z]\w*[a-z]|\w/\w+\.\w|\w\(\)")
_QUOTED = re.compile(r"[\"“`]")


def _names(sentence: str) -> bool:
    """Whether a sentence names code or quotes: an identifier, a path, a mark, which pages without content don't."""
    return bool(_QUOTED.search(sentence) or _IDENTIFIER.search(_JAVASCRIPT.sub("", sentence)))


def headed(text: str) -> tuple[str | None, str]:
    """(heading, rest): a first line that is marked as one, or stands above a blank line and is no sentence."""
    first, _, rest = text.strip().partition("\n")
    bare = " ".join(first.split())
    if not rest.strip():
        return None, text
    short = len(bare.split()) <= 8 and not re.search(r"[.!?…。！？:;,]$", bare)
    if re.match(r"#{1,6}\s", bare) or (short and not rest.split("\n", 1)[0].strip()) or re.match(r"[^\W\d_][\w.]*(?: [\w.]+)?: [\w ]{3,60}$", bare):
        return bare, rest
    return None, text


def body_of(text: str) -> list[tuple[str, bool]] | None:
    """(sentence, whether it is the heading) of a page without tags and furniture; null for texts that name code, left at
    the first such sentence. Furniture that is only learned is among the sentences."""
    text = unicodedata.normalize("NFKC", text.replace("\r\n", "\n").replace("\r", "\n")).translate(_CONFUSABLE)
    json_error = re.match(r'(?s)^\s*\{.*\}\s*$', text)
    if json_error:
        told = re.findall(r'"(?:error|message|detail|title|reason)"\s*:\s*"((?:[^"\\]|\\.)*)"', text)
        text = "\n".join(told) if told else text
    if "<" in text:
        text = _TAG.sub("\n", text)
    heading, text = headed(html.unescape(text))
    out = []
    for line in text.split("\n"):
        line = " ".join(line.split())
        if not line or _is_furniture(line):
            continue
        if _IDENTIFIER.search(_JAVASCRIPT.sub("", line)):
            return None
        bare = re.sub(r"^[>#*+\-\s]+|[*`]+|(?<!\w)_+|_+(?!\w)", "", line)
        for s in (p.strip() for p in _PAGE_SENTENCE.split(bare) if p):
            if s and not _is_furniture(s):
                if _QUOTED.search(s):
                    return None
                out.append((s, False))
    if heading and not _names(heading) and not _is_furniture(heading):
        out.insert(0, (re.sub(r"^[#\s]+", "", heading), True))
    return out


def kind_of(sentence: str) -> str:
    """sure if a sentence says no more than an error, a notice about scripts or filler; weak if it may; else empty."""
    bare = re.sub(r"^[^\w(©]+|\W+$", "", sentence)
    return "sure" if _SURE.fullmatch(bare) else "weak" if _HINTED.search(bare) else ""


def filler_words(text: str) -> list[str]:
    return re.findall(r"[^\W\d_]+", text.lower())


def repeated_filler(sentences: list[str]) -> bool:
    """Whether all there is are one to three words, or one sentence, over and over."""
    told = filler_words(" ".join(sentences))
    if len(told) >= 3 and len(set(told)) <= 3 and len(told) >= 3 * len(set(told)):
        return True
    same = {sentence_key(s) for s in sentences}
    return len(sentences) >= 3 and len(same) == 1


def sentence_key(sentence: str) -> str:
    """A sentence apart from case, punctuation and numbers."""
    return re.sub(r"\W+", " ", _MASK.sub("0", sentence.lower())).strip()


#: A sentence is known as a page's if it is in at least TEMPLATE_PAGES texts without names, of which this share say
#: what pages say besides; a word is a filler word if this share of its texts are lorem ipsum.
TEMPLATE_PAGES, TEMPLATE_SHARE, FILLER_TEXTS, FILLER_SHARE = 3, 0.6, 2, 0.5
#: A weak sentence is aligned with others: some of its words are slots, PAGE_WORDS others stay; what is before it by
#: up to PAGE_LEAD words may be furniture on the same line.
PAGE_WORDS, PAGE_LEAD = 3, 8
#: Longer sentences have too many skeletons to make them all: those that others could share are made, see ``shared_skeletons``.
MOST_SLOT_WORDS = 24
_SLICE = 50_000

INSPECTED = (
    "sure boolean, skeletons array<string>, doubtful array<string>, unfilled array<string>, filler boolean, sentences array<string>, kinds array<string>, told array<string>"
)


def inspect(text: str | None) -> tuple | None:
    """What one text shows by itself: a row of INSPECTED, or null if it shows nothing.

    ``sentences`` and their ``kinds`` are given for pages that name no code, ``told`` are the words of texts
    that name none, whatever their length; a heading that says nothing of a page is left out of all three.
    """
    if not text or not text.strip():
        return None
    found = slots(text)
    skeletons = sorted({k for yes, k, _ in found if yes})
    doubtful = sorted({k for yes, k, _ in found if not yes})
    unfilled = open_skeletons(text)
    body = body_of(text)
    sentences, kinds, told = None, None, None
    filler = False
    if body:
        kept = [(s, k) for s, k, heading in ((s, kind_of(s), h) for s, h in body) if k or not heading]
        sentences, kinds = [sentence_key(s) for s, _ in kept], [k for _, k in kept]
        filler = repeated_filler([s for s, heading in body if not heading])
    rest = headed(text)[1]
    if not _names(rest):
        told = filler_words(rest)
    if not (skeletons or doubtful or unfilled or filler or sentences or told):
        return None
    return bool(skeletons), skeletons, doubtful, unfilled, filler, sentences, kinds, told


_ARROW = [("sure", pa.bool_()), ("skeletons", pa.list_(pa.string())), ("doubtful", pa.list_(pa.string())), ("unfilled", pa.list_(pa.string())), ("filler", pa.bool_()),
          ("sentences", pa.list_(pa.string())), ("kinds", pa.list_(pa.string())), ("told", pa.list_(pa.string()))]


def inspected(documents: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The documents that show anything, with INSPECTED."""
    document_batches(documents.sparkSession)
    kind = documents.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, take = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                row = inspect(text)
                if row is not None:
                    rows.append(row)
                    take.append(i)
            columns = zip(*rows, strict=True) if rows else [[] for _ in _ARROW]
            arrays = [pa.array(c, k) for c, (_, k) in zip(columns, _ARROW, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(take, pa.int64())), *arrays], names=[doc_id, *[n for n, _ in _ARROW]])

    return documents.select(doc_id, "text").mapInArrow(run, f"`{doc_id}` {kind}, {INSPECTED}")


def skeletons_of(words: list[str]) -> Iterator[tuple[str, str]]:
    """(skeleton, slots) of a sentence: as it is, with one or two words as a slot, and with another word as a second one.

    Of more than MOST_SLOT_WORDS words as it is only; ``shared_skeletons`` gives the others.
    """
    yield " ".join(words), ""
    if len(words) > MOST_SLOT_WORDS:
        return
    spans = [(i, i + wide) for wide in (1, 2) for i in range(len(words) - wide + 1)]
    for k, (a, b) in enumerate(spans):
        for c, d in [(b, b), *spans[k + 1 :]]:
            if c >= b and len(words) - (b - a) - (d - c) >= PAGE_WORDS and not (c == b < d):
                parts = [*words[:a], "*", *words[b:c], *(["*"] if c < d else []), *words[d:]]
                yield " ".join(parts), " ".join(words[a:b] + words[c:d])


_PRIME, _BASE = (1 << 127) - 1, 0x3B9F0C61D7A4E8255A1C96F3E07B4D83


@lru_cache(maxsize=1 << 16)
def _word_hash(word: str) -> int:
    return int.from_bytes(hashlib.blake2b(word.encode(), digest_size=16).digest()) % _PRIME


class Runs:
    """Hashes of the runs of a sentence's words, each out of those of two beginnings, and of its skeletons."""

    def __init__(self, words: list[str]):
        self.words, self.values = words, [_word_hash(w) for w in words]
        self.heads, self.powers = [0], [1]
        for v in self.values:
            self.heads.append((self.heads[-1] * _BASE + v) % _PRIME)
            self.powers.append(self.powers[-1] * _BASE % _PRIME)

    def run(self, a: int, b: int) -> int:
        return (self.heads[b] - self.heads[a] * self.powers[b - a]) % _PRIME

    def skeleton(self, at: int, *slots: tuple[int, int]) -> str:
        """What stands for the words from ``at`` on with a mark for each of ``slots``."""
        told = 0
        for a, b in slots:
            told = ((told * self.powers[a - at] + self.run(at, a)) * _BASE + _word_hash("*")) % _PRIME
            at = b
        end = len(self.words)
        return f"#{(told * self.powers[end - at] + self.run(at, end)) % _PRIME:x}"


#: A place of a sentence: so many words from its start without its first ``lead`` ones (lead + 1), or from its end (0).
_SIDES = PAGE_LEAD + 2
#: The skeletons of longer sentences have two words less at least; those that have as many stand under their hash.
_FEWEST_HASHED = MOST_SLOT_WORDS - 1


def places_of(runs: Runs) -> Iterator[tuple[int, int, int]]:
    """(place, run of words up to there, next word) of a sentence, from its start, that without its first words, and its end."""
    n = len(runs.words)
    for lead in range(min(PAGE_LEAD, n - _FEWEST_HASHED) + 1):
        for k in range(1, n - lead + 1):
            yield k * _SIDES + lead + 1, runs.run(lead, lead + k) * 2, runs.values[lead + k] >> 64 if lead + k < n else -1
    for k in range(1, n + 1):
        yield k * _SIDES, runs.run(n - k, n) * 2 + 1, runs.values[n - k - 1] >> 64 if k < n else -1


def shared_skeletons(runs: Runs, lead: int, places: list[int]) -> Iterator[tuple[str, str]]:
    """Those of a sentence's (skeleton, slots) that matter: whatever sentences share a skeleton share one of these.

    ``places`` are those at which sentences that are alike so far go on in different ways. Sentences that share a skeleton are alike
    up to such a place f. Where the first slot begins before f - 1, it holds the same words in all of them and isn't needed, or one
    word in some and two in others; then the words behind it repeat the same word up to f, so that it may as well begin at f - 1,
    or they do up to the second slot, and it may as well have one word before that, at f - 1 or one that is repeated. The same holds for the second slot from the end.
    """
    words = runs.words[lead:]
    n = len(words)
    starts = {0} | {p // _SIDES for p in places if p % _SIDES == lead + 1}
    ends = {0} | {p // _SIDES for p in places if p % _SIDES == 0}
    begins, tails = ({k - less for k in of for less in (0, 1) if k >= less} for of in (starts, ends))

    def spots() -> Iterator[tuple[int, int, int, int]]:
        yield from ((a, a + u, n, n) for a in begins for u in (1, 2) if a + u <= n)
        for u, v in ((1, 1), (1, 2), (2, 2)):
            yield from ((a, a + u, n - e - v, n - e) for a in begins for e in tails if a + u < n - e - v)
            for a in range(max(0, n - max(ends) - u - v - 1), min(max(starts), n - u - v - 1) + 1):
                if (a in begins or a + 2 in starts or words[a + 1] == words[a + 2]) and not (a in begins and n - a - u - v - 1 in tails):
                    yield a, a + u, a + u + 1, a + u + 1 + v

    yield runs.skeleton(lead), ""
    for a, b, c, d in spots():
        slots = [(lead + a, lead + b), (lead + c, lead + d)][: 1 + (c < d)]
        yield runs.skeleton(lead, *slots), " ".join(words[a:b] + words[c:d])


def _rows(kinds: dict[str, pa.DataType], of):
    """A function for mapInArrow that gives the rows (kinds) of ``of`` for each row, in slices."""
    def table(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds.values(), strict=True)], names=list(kinds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for own in of(*row):
                    rows.append(own)
                    if len(rows) >= _SLICE:
                        yield table(rows)
                        rows = []
            yield table(rows)

    return run


def _branches(records: DataFrame) -> DataFrame:
    """(id, places) of the sentences of ``records`` (id, key) for ``shared_skeletons``: where others that are alike so far go on in another way."""
    def placed(id: bytes, key: str) -> Iterator[tuple]:
        return ((id, place, run.to_bytes(16), word) for place, run, word in places_of(Runs(key.split(" "))))

    kinds = {"id": pa.binary(), "place": pa.int64(), "run": pa.binary(), "word": pa.int64()}
    long = records.filter(F.size(F.split("key", " ")) >= _FEWEST_HASHED).select("id", "key")
    places = written(long.mapInArrow(_rows(kinds, placed), "id binary, place bigint, run binary, word bigint"))
    parted = places.groupBy("run").agg(F.min("word").alias("least"), F.max("word").alias("most")).filter("least <> most").select("run")
    return places.join(parted.hint("merge"), "run", "left_semi").groupBy("id").agg(F.collect_list("place").alias("places"))


def _aligned_sentences(records: DataFrame) -> DataFrame:
    """(id, n, sure, skeleton, slots, lead) of the sentences of ``records`` (id, key, n, sure), and of what is left of them without
    their first words; lead is the number of these."""
    def lined(id: bytes, key: str, n: int, sure: bool, places: list[int] | None) -> Iterator[tuple]:
        words = key.split(" ")
        runs = Runs(words) if len(words) > MOST_SLOT_WORDS else None
        for lead in range(min(PAGE_LEAD, len(words) - 1) + 1):
            if len(words) - lead > MOST_SLOT_WORDS:
                yield from ((id, n, sure, skeleton, slots, lead) for skeleton, slots in shared_skeletons(runs, lead, places or []))
                continue
            for skeleton, slots in skeletons_of(words[lead:]):
                yield id, n, sure, skeleton if skeleton.count(" ") + 1 < _FEWEST_HASHED else Runs(skeleton.split(" ")).skeleton(0), slots, lead

    kinds = {"id": pa.binary(), "n": pa.int64(), "sure": pa.bool_(), "skeleton": pa.string(), "slots": pa.string(), "lead": pa.int32()}
    told = records.join(_branches(records).hint("merge"), "id", "left").select("id", "key", "n", "sure", "places")
    return told.mapInArrow(_rows(kinds, lined), "id binary, n bigint, sure boolean, skeleton string, slots string, lead int")


def repeated_sentences(said: DataFrame) -> DataFrame:
    """The keys of ``said`` (doc_id, key, kind), weak or sure sentences, that the texts have over and over: in SLOT_RECORDS with other
    words in their slots, or as they are in SLOT_SAME or as a sure one, by themselves or behind furniture."""
    records = said.groupBy("key").agg(F.count(F.lit(1)).alias("n"), (F.min("kind") == "sure").alias("sure"))
    records = written(records.withColumn("id", F.unhex(F.md5("key"))))
    lined = written(_aligned_sentences(records))
    # the records of one key have the same words in its slots, those of others don't
    whole = lined.filter("lead = 0").groupBy("skeleton").agg(F.sum("n").alias("n"), F.countDistinct("slots").alias("values"), F.bool_or(F.col("sure") & (F.col("slots") == "")).alias("sure"))
    known = whole.filter("sure OR " + f"n >= {SLOT_RECORDS} AND (values >= {SLOT_VALUES} OR n >= {SLOT_SAME})").select("skeleton")
    repeated = lined.join(known.hint("merge"), "skeleton", "left_semi").select("id").distinct()  # both grow with the corpus
    return records.join(repeated.hint("merge"), "id", "left_semi").select("key")


def pages(seen: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """(doc_id) of the texts of which every sentence is a page's: by itself, or because the corpus has it in pages.

    One of them at least has to be sure, or a weak one that is repeated.
    """
    said = seen.filter(F.size("sentences") > 0).select(doc_id, F.explode(F.arrays_zip("sentences", "kinds")).alias("s")).select(doc_id, F.col("s.sentences").alias("key"), F.col("s.kinds").alias("kind"))
    said = written(said.distinct())
    # a text with a sentence of its own that says nothing of a page can't be one, so few are looked at any further
    counts = said.filter("kind = ''").groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    own = said.filter("kind = ''").join(counts.filter(F.col("n") < TEMPLATE_PAGES), "key", "left_semi").select(doc_id).distinct()
    said = written(said.join(own, doc_id, "left_anti"))
    telling = said.filter("kind <> ''")
    repeated = written(repeated_sentences(telling))
    shown = telling.join(repeated, "key", "left_semi").select(doc_id).unionByName(telling.filter("kind = 'sure'").select(doc_id)).distinct().withColumn("shown", F.lit(True))
    marked = said.join(shown, doc_id, "left")
    # sentences that say nothing of a page, nearly always beside some that do: furniture and the like
    beside = marked.filter("kind = '' AND shown").groupBy("key").agg(F.count(F.lit(1)).alias("with"))
    template = beside.join(counts, "key").filter((F.col("with") >= TEMPLATE_PAGES) & (F.col("with") >= F.col("n") * TEMPLATE_SHARE)).select("key")
    strange = marked.filter("shown AND kind = ''").join(template, "key", "left_anti").select(doc_id).distinct()
    return shown.select(doc_id).join(strange, doc_id, "left_anti")


def residues(documents: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, reason) of the documents that are template residue or a page without content, each once.

    reason is slot, filler, page or lorem, the first that holds.  Null, empty and blank texts are none.
    """
    seen = written(inspected(documents, doc_id))
    one = lambda df, reason, rank: df.select(doc_id, F.lit(reason).alias("reason"), F.lit(rank).alias("rank"))
    sure = one(seen.filter("sure"), "slot", 0)
    # slots of known skeletons: defaults and blanks count where others have names left
    known = seen.select(F.explode("skeletons").alias("skeleton")).distinct()
    doubtful = one(seen.filter("NOT sure").select(doc_id, F.explode("doubtful").alias("skeleton")).join(known, "skeleton", "left_semi").distinct(), "slot", 0)
    # and where other records have them filled
    unfilled = seen.filter("NOT sure").select(doc_id, F.explode("unfilled").alias("skeleton"))
    slotted = filled_slots(documents, cut_lineage(unfilled.select("skeleton").distinct()), doc_id)
    empty = one(unfilled.join(slotted, "skeleton", "left_semi").select(doc_id).distinct(), "slot", 0)
    filler = one(seen.filter("filler"), "filler", 1)
    page = one(pages(seen, doc_id), "page", 2)
    # filler texts in the vocabulary of lorem ipsum, learned from the texts that hold its first two words
    texts = seen.filter(F.size("told") > 0).select(doc_id, "told", (F.array_contains("told", "lorem") & F.array_contains("told", "ipsum")).alias("lorem"))
    vocabulary = texts.select(F.explode(F.array_distinct("told")).alias("word"), "lorem").groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.count_if("lorem").alias("n_lorem"))
    vocabulary = vocabulary.filter((F.col("n_lorem") >= FILLER_TEXTS) & (F.col("n_lorem") >= F.col("n") * FILLER_SHARE)).select("word", F.lit(1).alias("hit"))
    words = texts.select(doc_id, F.explode("told").alias("word")).groupBy(doc_id, "word").agg(F.count(F.lit(1)).alias("n")).join(vocabulary, "word", "left")
    share = words.groupBy(doc_id).agg((F.sum(F.col("n") * F.coalesce("hit", F.lit(0))) / F.sum("n")).alias("share"), F.sum("n").alias("n"))
    lorem = one(share.filter((F.col("share") >= FILLER_WORDS_SHARE) & (F.col("n") >= 4)), "lorem", 3)
    every = sure.unionByName(doubtful).unionByName(empty).unionByName(filler).unionByName(page).unionByName(lorem)
    return every.groupBy(doc_id).agg(F.min_by("reason", "rank").alias("reason"))


def kept(documents: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The documents that stay in the corpus: all others, null and blank ones included."""
    return documents.join(residues(documents, doc_id).select(doc_id), doc_id, "left_anti")
