"""Problem 2: template residue, filler and error-page text."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelode.llm.arrow import any_of, distinct_sorted, hash_words, line_tokens, mix, ranges
from sitelode.llm.canonical import canonical, canonical_lines
from sitelode.operators.components import connected_components
from sitelode.operators.dedupe import distinct_rows
from sitelode.session import broadcast_if_small, materialised

#: SimHash bits and distance: two sentences with a word similarity of SIMILARITY differ in at most 15 % of the bits on
#: average, 10 of 64, and in more than DISTANCE hardly ever.
BITS, DISTANCE, SIMILARITY = 64, 17, 0.8
#: Tables, each keyed by PARTS of the 16 runs of four bits.
TABLES, PARTS = 192, 4
#: Bytes of text whose sentences are written together, each distinct one once.
SLICE = 8 << 20
#: Links whose components are found in one task; more go through the distributed operator.
FEW_LINKS = 100_000
#: Bytes of sentences or keys that are broadcast at most.
BROADCAST = 32 << 20

#: Words of the customary Latin filler text.
_FILLER_WORDS = frozenset(
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna "
    "aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute "
    "irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non "
    "proident sunt culpa qui officia deserunt mollit anim id est laborum".split()
)
_FILLER_LEAD = frozenset("lorem ipsum amet adipiscing eiusmod aliqua aliquip nostrud ullamco laboris cillum fugiat pariatur mollit incididunt "
                         "consectetur velit nulla dolore tempor magna labore commodo".split())  # fmt: skip

_NAME = r"[A-Za-z_][\w.]*(?: [\w.]+){0,3}"
#: Syntaxes of unfilled placeholders.
PLACEHOLDER = re.compile(
    rf"\{{\{{\{{?[^{{}}\n]{{1,60}}\}}?\}}\}}|\{{%[^%\n]{{1,60}}%\}}|<%[=-]?[^%\n]{{1,60}}%>|<\?(?:php|=)[^?\n]{{1,80}}\?>"
    rf"|[$#]\{{{_NAME}\}}|\[\[{_NAME}\]\]|%[A-Z][A-Z_]{{2,}}%|##[A-Z][A-Z_]{{1,}}##|@@{_NAME}@@|__[A-Z][A-Z_]{{2,}}__|\*\|{_NAME}\|\*"
    rf"|<<{_NAME}>>|&lt;{_NAME}&gt;|\bXXX {_NAME} XXX\b|\[(?:insert|your|enter|add) [^\]\n]{{2,40}}\]|(?<![\w{{]){{\d}}(?![\w}}])"
    rf"|\b(?:TODO|TBD|FIXME|TK): ?\w+|\[object Object\]",
)
_BRACKETED = re.compile(r"\[(?:insert|your|enter|add) [^\]\n]{2,40}\]", re.I)
#: Filler sentences left by page builders; matched on a sentence.
FILLER = re.compile(
    r"\b(?:your [\w-]+(?: [\w-]+)? text goes here|heading for [\w-]+(?: [\w-]+)? goes here|[\w-]+ (?:text|copy|title|heading) goes here"
    r"|type your [\w-]+(?: [\w-]+)? text and press save|add a short description of your [\w-]+(?: [\w-]+)? in this box"
    r"|write something about your [\w-]+(?: [\w-]+)? here|click (?:edit|here) to (?:change|edit) (?:this|the) [\w-]+"
    r"|this is (?:sample|dummy|placeholder|example) (?:text|copy|content)|placeholder (?:copy|text|content) for the [\w-]+"
    r"|dummy (?:paragraph|text|copy), to be replaced|(?:sample|dummy|placeholder) (?:text|copy|paragraph) for the [\w-]+"
    r"|replace this (?:text|copy|paragraph)|text text text text|(?:asdf[ ,]+){2,}\w*|(?:qwerty?[ ,]+){2,}\w*|bla bla bla|xxx xxx xxx"
    r"|hier steht (?:ihr|dein|der) (?:text|titel)|(?:hier|an dieser stelle) (?:kommt|folgt) (?:ihr|der|ein) text|(?:blindtext|platzhaltertext)\b"
    r"|votre texte ici|texte à (?:remplacer|venir)|(?:su|tu) texto aquí|texto de (?:relleno|ejemplo)|здесь (?:будет|ваш) текст|текст-заглушка"
    r"|ここに(?:本文|テキスト|文章)を(?:入力|入れ)|ダミーテキスト|サンプルテキスト)",
    re.I,
)
#: Speaking about such text rather than leaving it: not residue.
MENTION = re.compile(
    r"\b(?:you|we|they|i) (?:write|wrote|type|typed|put|see|use)\b|\b(?:is|are|was|were|be) (?:replaced|written|printed|called|known|filled)\b"
    r"|\b(?:says|said|explains|means) that\b.*\b(?:is|are)\b|\breads? \S+ first\b|\bset it before\b|\bonce set\b|\bstands for\b|\bsearching for\b"
    r"|\bwrote about\b|\bto judge\b|\bbefore the copy\b|\bturned off, \w+ explains\b",
    re.I,
)
_STATUS = r"(?:bad request|unauthorized|forbidden|not found|page not found|method not allowed|request time-?out|gone|too many requests|internal server error|bad gateway|service unavailable|gateway time-?out)"
#: Error messages and notices; each matches a whole line or sentence.
NOTICE = re.compile(
    rf"(?:(?:http|error|status|fehler|erreur|error) ?:? ?)?\b[45]\d\d\b ?[-|:–]? ?{_STATUS}\.?"
    rf"|(?:http|error|fehler|erreur|ошибка|エラー)(?: code)? ?[45]\d\d ?[-|:–]? ?(?:{_STATUS}|.{{0,60}})"
    r"|[45]\d\d ?[:|-] ?(?:la |die |der )?(?:page|página|seite|страница|ページ).{0,50}"
    r"|(?:access|permission) denied\.?|acceso denegado\.?|accès (?:refusé|interdit)\.?|zugriff verweigert\.?|доступ (?:запрещ[её]н|закрыт)\.?|アクセスが拒否されました。?"
    r"|you do(?: not|n't) have permission to (?:view|access) .{3,80}"
    r"|the requested url .{5,80}|your support id is\W.{0,40}|this domain (?:is parked|name is|may be).{0,60}|(?:domain|site) (?:is )?for sale.{0,30}"
    r"|(?:uh-?oh|oops|sorry|well|hmm|whoops)\b.{0,12}\b(?:page|address|that|this|nothing|we|something)\b.{0,80}"
    r"|that page has .{3,60}|the page (?:is gone|you .{3,60})|the address you .{5,80}|(?:please )?check the (?:link|address) .{0,60}"
    r"|(?:this |the )?page (?:could|can)(?:not| not) be (?:found|displayed|shown).{0,40}|(?:the )?page not found\.?"
    r"|the server (?:did not|didn't|could not|is) .{3,60}|your session has expired\b.{0,60}|sign in again to continue\.?"
    r"|(?:we are|we're|site is|this site is) (?:down|offline|closed|under) (?:for )?.{0,60}|back soon\b.{0,60}|under (?:construction|maintenance)\.?"
    r"|this (?:shop|site|store|page) is (?:temporarily|currently|being) .{3,80}|scheduled maintenance\.?|(?:site|page) is being updated\.?"
    r"|(?:you need to|please|you must)? ?(?:enable|activate|allow|switch on|turn on) (?:javascript|java script|scripts?|active scripting|cookies)\b.{0,80}"
    r"|(?:this|the|our) (?:site|page|app|shop) (?:requires|needs) (?:javascript|scripts?)\b.{0,80}|turn them on and reload .{0,40}"
    r"|(?:javascript|scripts?|cookies) (?:is|are|may be|seems?) (?:disabled|blocked|turned off|off|required|not enabled)\b.{0,60}"
    r"|your browser is (?:too old|not supported|out of date|outdated)\b.{0,80}|loading ?(?:\.\.\.|…).{0,80}|if nothing happens\b.{0,60}"
    r"|the content of this page can(?:'t|not|’t) be .{3,60}|checking your browser\b.{0,60}|(?:this )?takes a few seconds\.?|verify (?:that )?you are (?:a )?human\b.{0,60}|are you a robot\b.{0,30}"
    r"|ddos protection by .{2,40}|ray id\W.{4,40}|fatal error: .{5,100}|(?:warning|notice|parse error): .{5,120} on line \d+\.?|traceback \(most recent call last\):.*"
    r"|file \".{3,80}\", line \d+.{0,60}|(?:key|value|type|attribute|name|index|runtime|zerodivision|import|syntax)error: .{1,80}|.{0,40}(?:null ?pointer|unhandled|uncaught) ?(?:exception|error).{0,80}"
    r"|error establishing a database connection\.?|could not connect to the database.{0,40}|(?:nginx|apache)(?:/[\d.]+)?(?: .{0,20})?|index of /.{0,60}"
    r"|reference #[0-9a-f.]{5,}|request blocked\.?|too many requests\.?|service unavailable\.?"
    r"|bitte (?:aktivieren|schalten) sie (?:javascript|scripts?|skripte)\b.{0,80}|(?:diese )?seite (?:wurde )?nicht gefunden\.?|(?:die )?(?:angeforderte |gesuchte )?seite (?:konnte|existiert|wurde) .{3,60}"
    r"|wartungsarbeiten\b.{0,60}|bitte versuchen sie es später.{0,20}|fehler \d{3}.{0,60}"
    r"|(?:veuillez )?(?:activer|activez) javascript\b.{0,80}|page (?:introuvable|non trouvée)\.?|la page (?:demandée|que vous).{3,60}|(?:site )?en (?:cours de )?maintenance\b.{0,60}|erreur \d{3}.{0,60}"
    r"|(?:active|habilite|activa|por favor,? active) javascript\b.{0,80}|página no encontrada\.?|la página que .{3,60}|(?:sitio )?en mantenimiento\b.{0,60}|vuelva (?:pronto|más tarde)\.?"
    r"|включите (?:javascript|скрипты)\b.{0,80}|страница не найдена.{0,40}|(?:запрошенная )?страница .{0,20}не (?:существует|найдена).{0,20}|(?:сайт|страница) (?:временно )?(?:недоступ|закрыт|на обслуж).{0,60}|(?:ведутся )?технические работы.{0,60}|зайдите позже\.?"
    r"|(?:このページを表示するには、?)?javascript(?:を有効に|が無効).{0,40}|(?:お探しの)?ページ(?:が|は)(?:見つかりません|存在しません|ありません).{0,20}|(?:ただいま)?メンテナンス中.{0,20}|しばらく(?:して|お待ち).{0,30}",
    re.I,
)
#: Of the notices, those that are told apart inside a longer line: they begin with a capital.
INLINE = re.compile(NOTICE.pattern, re.I)
_CODE = re.compile(r"[45](?<!\d[45])\d\d")
_SENTENCES = re.compile(r"(?<=[.!?。！？:])\s+|(?<=[。！？])")
#: The same for a text without wide ends; it begins with a plain class, so that the search skips to it.
_SPACED, _WIDE_END = re.compile(r"\s(?<=[.!?:]\s)\s*"), re.compile(r"[。！？]")
_WORD = re.compile(r"[^\W_]+")
_DIGIT, _DIGITS = re.compile(r"\d"), re.compile(r"\d+")

#: Words of which any notice has one, unless it is :func:`_glued`; a line without them is not matched against the notices.
_NOTICE_WORDS = frozenset(
    "denied permission requested support parked sale page address gone wandered locate link server session sign down offline "
    "closed construction maintenance soon updated enable activate allow switch turn javascript script scripts scripting cookies requires needs "
    "disabled blocked off browser loading happens content checking seconds human robot ddos ray fatal warning notice parse traceback file keyerror "
    "valueerror typeerror attributeerror nameerror indexerror runtimeerror zerodivisionerror importerror syntaxerror error exception pointer nginx "
    "apache index reference request requests service unavailable unauthorized forbidden found gone gateway out bad method denegado refusé "
    "interdit verweigert запрещён запрещен закрыт доступ seite wartungsarbeiten versuchen fehler introuvable trouvée demandée que maintenance erreur "
    "activer activez active habilite activa página mantenimiento vuelva включите страница сайт работы зайдите ошибка http status domain oops sorry uh uhoh hmm whoops well time-out "
    "site temporarily currently being under connect skripte технические"
    .split()
)
_CJK_NOTICE = re.compile("javascript|ページ|メンテナンス|しばらく|アクセス|エラー|ダミー|サンプル|ここに", re.I)
#: A character of which any match of _CJK_NOTICE has one.
_CJK_BEGIN = re.compile("[jJペメしアエダサこ]")
_FILL_WORDS = frozenset(
    "text here description box sample dummy placeholder example copy paragraph click replace asdf qwer qwert qwerty bla xxx hier platzhaltertext "
    "blindtext texte texto текст заглушка".split()
)
#: A line without any of these words, marks and codes has no label.
_ANY_WORDS = _NOTICE_WORDS | _FILL_WORDS | _FILLER_LEAD
_MARKED = re.compile(r"\{|\}|<|\[|##|%[A-Z_]|&lt;|\*\||__|@@|XXX|TODO|TBD|FIXME|TK:")
_START = re.compile(r"(?:(?<=\s)|(?<=[.!?。])|\A)(?=[A-ZÀ-ÞА-ЯЁ0-9぀-鿿])")

#: In place of a character that may be any.
_ANY_CHARACTER = "\0"


def _heads(tree) -> set[str]:
    """The first two characters, lower-cased, of what a parsed pattern can match; all of it, where that is shorter."""
    heads = {""}
    for op, arg in tree:
        op = str(op)
        if op == "LITERAL":
            own = {chr(arg).lower()}
        elif op == "IN" and all(str(x[0]) == "LITERAL" for x in arg):
            own = {chr(x).lower() for _, x in arg}
        elif op == "IN" and [str(x) for _, x in arg] == ["CATEGORY_DIGIT"]:
            own = set("0123456789")
        elif op == "SUBPATTERN":
            own = _heads(arg[-1])
        elif op == "BRANCH":
            own = set().union(*map(_heads, arg[1]))
        elif op == "MAX_REPEAT":
            least, most, of = arg
            one, own, again = _heads(of), set(), {""}
            for k in range(min(int(most), max(int(least), 2)) + 1):
                own |= again if k >= least else set()
                again = {(x + y)[:2] for x in again for y in one}
        elif op == "AT":
            own = {""}
        else:
            own = {_ANY_CHARACTER}
        heads = {(x + y)[:2] for x in heads for y in own}
    return heads


_NOTICE_HEADS = _heads(re._parser.parse(NOTICE.pattern, re.I))
#: Characters that stand for others where case is ignored, and digits that are not plain: the first two do not tell.
_ODD = re.compile("[ıİſᲀ-ᲈ]")
_GLUED_PARTS = ("pointer", "unhandled", "uncaught")


def _may_begin(text: str, at: int = 0) -> bool:
    """Whether a notice may begin at a place of a text: a cheap look at two characters; one begins with any before _GLUED_PARTS."""
    head = text[at : at + 2]
    return head.lower() in _NOTICE_HEADS or head[:1].lower() in _NOTICE_HEADS or not head.isascii() and (_ODD.search(head) or _DIGIT.search(head)) is not None


PLACE, FILL, ERROR = 1, 2, 4


def _has_cjk_notice(text: str) -> bool:
    return bool(_CJK_BEGIN.search(text) and _CJK_NOTICE.search(text))


def _glued(text: str) -> bool:
    """Whether a text has a status code or a part of a notice that may stand within a longer word."""
    if ("4" in text or "5" in text) and _CODE.search(text):
        return True
    return _has_glued_part(text)


def _has_glued_part(text: str) -> bool:
    low = text.lower()
    return any(x in low for x in _GLUED_PARTS)


def _notice_within(text: str) -> bool:
    """Whether a notice begins at a capitalised word of a text of one line, outside a sentence about such things."""
    if not (_NOTICE_WORDS.intersection(_WORD.findall(text.lower())) or _has_cjk_notice(text) or _glued(text)):
        return False
    anywhere = _has_glued_part(text)
    for m in _START.finditer(text):
        if not anywhere and not _may_begin(text, m.start()):
            continue
        hit = INLINE.match(text, m.start())
        if hit:
            end = re.compile(r"[.!?。]").search(text, hit.end())
            begin = max(text.rfind(c, 0, m.start()) for c in ".!?。")
            if not MENTION.search(text[begin + 1 : end.end() if end else len(text)]):
                return True
    return False


def label_sentence(text: str, words: list[str]) -> int:
    """The residue label of one sentence or line: PLACE, FILL, ERROR (a sum) or 0."""
    wide = not text.isascii() and _has_cjk_notice(text)
    if wide or not _NOTICE_WORDS.isdisjoint(words) or _glued(text):
        if (_may_begin(text) or _has_glued_part(text)) and NOTICE.fullmatch(text):
            return ERROR
    hit = _MARKED.search(text) and (PLACEHOLDER.search(text) or _BRACKETED.search(text))
    fill = (wide or not _FILL_WORDS.isdisjoint(words)) and FILLER.search(text)
    latin = False
    if not hit and not fill and len(words) >= 4 and not _FILLER_LEAD.isdisjoint(words):
        run = best = 0
        for w in words:
            run = run + 1 if w in _FILLER_WORDS else 0
            best = max(best, run)
        latin = best >= 8 or sum(w in _FILLER_WORDS for w in words) >= 0.8 * len(words)
    if (hit or fill or latin) and not MENTION.search(text):
        return PLACE if hit else FILL
    return 0


Unit = tuple[str, int, list[str]]


def page_units(content: str, known: dict[str, list[Unit]]) -> list[Unit]:
    """The sentences of a text in its one spelling, each with its label and its words."""
    out: list[Unit] = []
    raw = content.split("\n")
    for line in raw:
        got = known.get(line)
        if got is None:
            got = known[line] = _units_of(line)
        out += got
    return out + _whole_notice(content) if len(raw) == 1 and not any(x for _, x, _ in out) else out


def _whole_notice(content: str) -> list[Unit]:
    """A text of one line as a notice, if it has one within."""
    whole = canonical(content)
    return [(whole, ERROR, _WORD.findall(whole.lower()))] if _notice_within(whole) else []


def _sentences(text: str) -> list[str]:
    return (_SPACED if text.isascii() or not _WIDE_END.search(text) else _SENTENCES).split(text)


def _units_of(line: str) -> list[Unit]:
    """The sentences of a line of any spelling."""
    return [x for part in canonical(line).split("\n") for x in _line_units(part.strip())]


def _line_units(whole: str) -> list[Unit]:
    """The sentences of one line with their labels and words; a line that is a notice is one."""
    if not whole:
        return []
    parts = [p for x in _sentences(whole) if (p := x.strip())] if len(whole) > 12 else [whole]
    units = [(p, _WORD.findall(p.lower())) for p in parts]
    every = units[0][1] if len(units) == 1 else [w for _, words in units for w in words]
    if not (
        not _ANY_WORDS.isdisjoint(every)
        or _MARKED.search(whole) or _glued(whole) or not whole.isascii() and _has_cjk_notice(whole)
    ):
        return [(p, 0, words) for p, words in units]
    label = label_sentence(whole, every)
    if label == ERROR or len(units) == 1:
        return [(whole, label, every)]
    out = [(p, label_sentence(p, words), words) for p, words in units]
    if label and not any(x for _, x, _ in out):
        out.append((whole, label, every))  # a placeholder that the split cut
    return out


def sim_hashes(token_lists: list[list[str]]) -> np.ndarray:
    """64-bit SimHashes of token lists (empty: 0), tokens weighted by their number."""
    flat = [t for ts in token_lists for t in ts]
    if not flat:
        return np.zeros(len(token_lists), np.int64)
    codes, distinct = pd.factorize(np.array(flat, dtype=object))
    return _sim_hashes(np.array([len(t) for t in token_lists]), codes, _hashed(distinct)).view(np.int64)


def _hashed(words: list[str]) -> np.ndarray:
    return pd.util.hash_array(np.array(words, dtype=object), categorize=False).astype(np.uint64)


def _sim_hashes(size: np.ndarray, codes: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """SimHashes of lists of so many tokens, given by their places in ``hashes``."""
    out = np.zeros(len(size), np.uint64)
    # Each bit in a byte of its own, eight in a number: sums of up to 255 tokens carry nothing over.
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    lanes = bits.view(np.uint64)
    end = np.cumsum(size)
    at = 0
    while at < len(size):  # slices of about 2^17 tokens
        to = max(at + 1, int(np.searchsorted(end, end[at] - size[at] + (1 << 17))))
        rows = np.flatnonzero(size[at:to]) + at
        if len(rows):
            begin = end[rows] - size[rows]
            sums = np.add.reduceat(lanes[codes[begin[0] : end[rows[-1]]]], begin - begin[0], axis=0).view(np.uint8).astype(np.int64)
            for k in np.flatnonzero(size[rows] > 255).tolist():
                sums[k] = bits[codes[begin[k] : end[rows[k]]]].sum(0, dtype=np.int64)
            out[rows] = np.packbits(2 * sums > size[rows][:, None], axis=1).view(">u8").ravel()
        at = to
    return out


def _n_parts(size: np.ndarray) -> np.ndarray:
    """Parts that the words of a set are dealt to: at least one more than the words by which a set near it may differ.

    Beyond 16 in steps of a quarter, so that sets of nearly any size are looked up by few numbers of parts.
    """
    n = np.floor(size * (1 - SIMILARITY) / SIMILARITY + 1e-9).astype(np.int64) + 1
    steps = np.ceil(16 * 1.25 ** np.ceil(np.log(np.maximum(n, 16) / 16) / np.log(1.25))).astype(np.int64)
    return np.where(n > 16, np.maximum(n, steps), n)


def _part_keys(row: np.ndarray, hashes: np.ndarray, n_parts: np.ndarray) -> np.ndarray:
    """The keys, set by set, of the parts of word sets whose words are dealt, by their hashes, to so many parts.

    ``row`` has the set of each of the words in ``hashes``.

    Sets dealt to more parts than there are words that only one of them has
    agree in a part, and so in its key.
    """
    hashes = mix(hashes)
    begin = np.cumsum(n_parts) - n_parts
    total = np.zeros(int(n_parts.sum()), np.uint64)
    part = ((hashes >> np.uint64(32)) % n_parts[row].astype(np.uint64)).astype(np.int64)
    with np.errstate(over="ignore"):
        np.add.at(total, begin[row] + part, hashes)
        place = np.arange(len(total)) - np.repeat(begin, n_parts)
        keys = mix(total + mix(np.repeat(n_parts, n_parts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + place.astype(np.uint64)))
    return (keys >> np.uint64(32)).astype(np.uint32).view(np.int32)


def own_keys(word_sets: list) -> tuple[np.ndarray, np.ndarray]:
    """The keys by which sentences are found, and how many each has."""
    size = np.array([len(s) for s in word_sets], np.int64)
    n_parts = _n_parts(size)
    return _part_keys(np.repeat(np.arange(len(size)), size), hash_words([w for s in word_sets for w in s]), n_parts), n_parts


def _sims_and_keys(word_lists: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The SimHashes of sentences, and what :func:`own_keys` gives of them, the words coded once."""
    size = np.array([len(ws) for ws in word_lists], np.int64)
    codes, distinct = pd.factorize(np.array([w for ws in word_lists for w in ws], dtype=object))
    return _coded_sims_and_keys(size, codes, distinct)


def _coded_sims_and_keys(size: np.ndarray, codes: np.ndarray, distinct: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """:func:`_sims_and_keys` of sentences of so many words, given by their places in ``distinct``."""
    if not len(codes):
        return np.zeros(len(size), np.int64), *own_keys([()] * len(size))
    sims = _sim_hashes(size, codes, _hashed(["0" if w.isdigit() else w for w in distinct]))
    same, forms = pd.factorize(np.array([w if w.isalpha() else _DIGITS.sub("0", w) for w in distinct], dtype=object))
    row, form = np.divmod(distinct_sorted(np.repeat(np.arange(len(size)), size) * len(forms) + same[codes]), len(forms))
    n_parts = _n_parts(np.bincount(row, minlength=len(size)))
    return sims.view(np.int64), _part_keys(row, _hashed(forms)[form], n_parts), n_parts


def search_keys(word_sets: list) -> tuple[np.ndarray, np.ndarray]:
    """The keys to look sentences up by, and how many each has: for each number of parts that a near set of any possible size has."""
    every = [
        (i, k) for i, s in enumerate(word_sets)
        for k in np.unique(_n_parts(np.arange(np.ceil(len(s) * SIMILARITY - 1e-9), len(s) / SIMILARITY + 1e-9))).tolist()
    ]
    row, n_parts = (np.array(x, np.int64) for x in zip(*every))
    size = np.array([len(word_sets[i]) for i in row], np.int64)
    words = hash_words([w for i in row for w in word_sets[i]])
    return _part_keys(np.repeat(np.arange(len(row)), size), words, n_parts), np.bincount(row, n_parts, len(word_sets)).astype(np.int64)


_UNITS = "id long, unit long, label int, sim long, text string, keys array<int>"


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of SLICE bytes of text, or of one record with more."""
    if not batch.num_rows:
        return
    ends = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE, "right")))
        yield batch.slice(at, to - at)
        at = to


#: Bits of a word: it may stand in a notice, in filler, in Latin filler; it may be a part of a notice within a longer word; it has a digit.
_IN_NOTICE, _IN_FILL, _IN_LATIN, _IS_GLUED, _HAS_DIGIT = 1, 2, 4, 8, 16
_WORD_BITS = {
    w: _IN_NOTICE * (w in _NOTICE_WORDS) + _IN_FILL * (w in _FILL_WORDS) + _IN_LATIN * (w in _FILLER_LEAD) for w in _ANY_WORDS
}
#: Stands where a sentence ends; the one spelling has no such character.
_CUT = "\x1e"


def _word_bits(words: np.ndarray) -> np.ndarray:
    bits = np.array([_WORD_BITS.get(w, 0) for w in words], np.uint8)
    for i, w in enumerate(words):
        if not w.isalpha() and _DIGIT.search(w):
            bits[i] |= _HAS_DIGIT
        if _glued(w):
            bits[i] |= _IS_GLUED
    return bits


def _cut_lines(wholes: list[str]) -> tuple[list[str], np.ndarray]:
    """The sentences of lines in the one spelling, cut in all at once, and how many each has."""
    cut = "\n".join(wholes)
    spaces = [space for space in " \t\r" if space in cut]
    for end in ".!?:":
        for space in spaces:
            cut = cut.replace(end + space, end + _CUT)
    for end in "。！？":
        cut = cut.replace(end, end + _CUT)
    texts, size = [], []
    for whole, one in zip(wholes, cut.split("\n")):
        if _CUT in one and len(whole) > 12:
            parts = [p for x in one.split(_CUT) if (p := x.strip())]
            texts += parts
            size.append(len(parts))
        elif whole:
            texts.append(whole)
            size.append(1)
        else:
            size.append(0)
    return texts, np.array(size, np.int64)


class _Units:
    """What :func:`_units_of` gives of each of some lines (and :func:`_whole_notice`, of ``alone`` of them), found for all lines at once.

    The units of line i are ``of[begin[i] : begin[i] + size[i]]``, with ``texts``, ``labels`` and words
    ``codes[at[u] : at[u] + n[u]]`` of ``words``.  ``alone`` is the place of those lines as texts of one line.
    """

    def __init__(self, lines: list[str], alone: np.ndarray):
        forms = canonical_lines(lines)
        parts = [x.strip() for x in "\n".join(forms).split("\n")] if forms else []
        n_parts = np.array([1 + form.count("\n") for form in forms], np.int64) if len(parts) > len(forms) else np.ones(len(forms), np.int64)
        texts, size = _cut_lines(parts)
        self.codes, self.words, n = line_tokens(texts)
        at = np.cumsum(n) - n
        first = np.cumsum(size) - size
        bits = _word_bits(self.words)
        own = any_of(bits[self.codes], n)
        every = any_of(own, size)
        marked = np.zeros(len(parts), bool)
        ends = np.cumsum([len(x) + 1 for x in parts])
        marked[np.searchsorted(ends, [m.start() for m in _MARKED.finditer("\n".join(parts))], "right")] = True
        wide = np.array([not x.isascii() and _has_cjk_notice(x) for x in parts], bool)
        labels = np.zeros(len(texts), np.int32)
        gone = np.zeros(len(texts), bool)
        more: list[tuple[str, int, int, int, int]] = []  # text, label, begin and number of words, part
        telling = _IN_NOTICE | _IN_FILL | _IN_LATIN | _IS_GLUED
        for k in np.flatnonzero(((every & telling) > 0) | marked | wide).tolist():
            if not size[k]:
                continue
            whole, i, j = parts[k], int(first[k]), int(first[k] + size[k])
            begin, n_words = int(at[i]), int(n[i:j].sum())
            label = label_sentence(whole, self.words[self.codes[begin : begin + n_words]].tolist())
            if j == i + 1:
                labels[i] = label
                continue
            if label == ERROR:
                gone[i:j] = True
                more.append((whole, label, begin, n_words, k))
                continue
            for u in range(i, j):
                if own[u] & telling or marked[k] or wide[k]:
                    labels[u] = label_sentence(texts[u], self.words[self.codes[at[u] : at[u] + n[u]]].tolist())
            if label and not labels[i:j].any():
                more.append((whole, label, begin, n_words, k))  # a placeholder that the split cut
        of_part = np.concatenate([np.repeat(np.arange(len(parts)), size), np.array([x[4] for x in more], np.int64)])
        units = np.concatenate([np.flatnonzero(~gone), np.arange(len(texts), len(texts) + len(more))])
        units = units[np.argsort(of_part[units], kind="stable")]
        line_of_part = np.repeat(np.arange(len(forms)), n_parts)
        self.size = np.bincount(line_of_part[of_part[units]], minlength=len(forms)).astype(np.int64)
        self.begin = np.cumsum(self.size) - self.size
        labels = np.concatenate([labels, np.array([x[1] for x in more], np.int32)])
        # Texts of one line: the units of the line, and it all where a notice stands within.
        labelled = np.add.reduceat(np.append(labels[units], 0), self.begin) * (self.size > 0) if len(forms) else self.size
        part = np.cumsum(n_parts) - n_parts
        may = any_of(every, n_parts) & (_IN_NOTICE | _IS_GLUED)
        n_line, self.alone, within = len(forms), {}, []
        for i in alone.tolist():
            self.alone[i] = i
            if not labelled[i] and (may[i] or not forms[i].isascii()) and _notice_within(forms[i]):
                a, b = first[part[i]], first[part[i]] + size[part[i] : part[i] + n_parts[i]].sum()
                within.append((forms[i], ERROR, int(at[a]), int(n[a:b].sum()), i))
                self.alone[i] = n_line + len(within) - 1
        for k, (*_, i) in enumerate(within):
            units = np.concatenate([units, units[self.begin[i] : self.begin[i] + self.size[i]], [len(labels) + k]])
        if within:
            self.size = np.concatenate([self.size, self.size[[x[4] for x in within]] + 1])
            self.begin = np.cumsum(self.size) - self.size
        more += within
        self.of = units
        self.labels = np.concatenate([labels, np.full(len(within), ERROR, np.int32)])
        self.texts = texts + [x[0] for x in more]
        self.at = np.concatenate([at, np.array([x[2] for x in more], np.int64)])
        self.n = np.concatenate([n, np.array([x[3] for x in more], np.int64)])
        self.bits = bits


def _unit_hashes(units: _Units, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Hashes of the words of sentences in their order, numbers as 0."""
    row, codes = np.repeat(np.arange(len(n)), n), units.codes[ranges(at, n)]
    plain = _hashed(units.words)
    number = np.where([w.isdigit() for w in units.words], _hashed(["0"])[0], plain)
    digits = any_of(units.bits[codes], n) & _HAS_DIGIT
    with np.errstate(over="ignore"):
        place = (ranges(np.zeros(len(n), np.int64), n) + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        each = mix(np.where(digits[row] > 0, number[codes], plain[codes]) + place)
        total = np.zeros(len(n), np.uint64)
        some = np.flatnonzero(n)
        if len(some):
            total[some] = np.add.reduceat(each, (np.cumsum(n) - n)[some])
        return mix(total + n.astype(np.uint64)).view(np.int64)


def _unit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(id, unit, label, sim, text, keys)`` of every sentence; all but the first three once a unit of some records (see :func:`_slices`)."""
    for batch in batches:
        for part in _slices(batch):
            raw = [content.split("\n") for content in part.column("text").to_pylist()]
            n_lines = np.array([len(lines) for lines in raw], np.int64)
            lines, distinct = pd.factorize(np.array(list(chain.from_iterable(raw)), dtype=object))
            alone = (np.cumsum(n_lines) - n_lines)[n_lines == 1]
            units = _Units(distinct.tolist(), np.unique(lines[alone]))
            lines[alone] = [units.alone[i] for i in lines[alone].tolist()]
            size = units.size[lines]
            own = units.of[ranges(units.begin[lines], size)]
            ids = np.repeat(part.column("id").to_numpy(zero_copy_only=False), np.add.reduceat(size, np.cumsum(n_lines) - n_lines))
            if not len(ids):
                continue
            label, unit = units.labels[own], _unit_hashes(units, units.at, units.n)[own]
            # Of a unit's sentences one stands for it, a labelled one if there is one.
            order = np.lexsort((-label, unit))
            first = np.sort(order[np.append(True, np.diff(unit[order]) != 0)])  # keys in the order of the rows
            chosen = own[first]
            sims = np.zeros(len(own), np.int64)
            sims[first], keys, n_keys = _coded_sims_and_keys(units.n[chosen], units.codes[ranges(units.at[chosen], units.n[chosen])], units.words)
            shown = np.full(len(own), None, object)
            shown[first] = [units.texts[k] for k in chosen.tolist()]
            size = np.zeros(len(own), np.int64)
            size[first] = n_keys
            ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (ids, unit, label, sims)]
                + [pa.array(shown, pa.string()), pa.ListArray.from_arrays(pa.array(ends), pa.array(keys), mask=pa.array(size == 0))],
                ["id", "unit", "label", "sim", "text", "keys"],
            )


_DRAWN = np.random.default_rng(3)
_PICKS = [_DRAWN.choice(BITS // 4, PARTS, replace=False) for _ in range(TABLES)]


def _table_keys(sims: np.ndarray) -> Iterator[np.ndarray]:
    """The keys of SimHashes in each of the tables."""
    parts = [((sims.view(np.uint64) >> np.uint64(4 * k)) & np.uint64(15)).astype(np.int32) for k in range(BITS // 4)]
    for picks in _PICKS:
        key = parts[picks[0]]
        for k in picks[1:]:
            key = (key << 4) | parts[k]
        yield key


def candidates(seeds: np.ndarray, keys: list[np.ndarray], order: list[np.ndarray], sims: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in ``seeds`` and ``sims`` that share a table key and lie within DISTANCE bits.

    ``keys`` are the sorted keys of the seeds in each table, ``order`` their positions.
    """
    there = np.zeros(1 << (4 * PARTS), bool)
    found = []
    for own, place, key in zip(keys, order, _table_keys(sims)):
        there[own] = True
        hit = np.flatnonzero(there[key])
        there[own] = False
        begin = np.searchsorted(own, key[hit])
        n = np.searchsorted(own, key[hit], "right") - begin
        b = np.repeat(hit, n)
        a = place[np.arange(n.sum()) + np.repeat(begin - (np.cumsum(n) - n), n)]
        close = np.bitwise_count((seeds[a] ^ sims[b]).view(np.uint64)) <= DISTANCE
        found.append(a[close] * len(sims) + b[close])
    both = np.unique(np.concatenate(found))
    return both // len(sims), both % len(sims)


def _word_set(text: str) -> frozenset[str]:
    return frozenset(_WORD.findall(_DIGITS.sub("0", text.lower())))


def _probes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """``(a, sim_a, text_a, keys)``: sentences and the keys to look them up by."""
    for batch in batches:
        if len(batch):
            keys, n = search_keys([_word_set(t) for t in batch["text"]])
            yield pd.DataFrame({"a": batch["unit"], "sim_a": batch["sim"], "text_a": batch["text"], "keys": np.split(keys, np.cumsum(n)[:-1])})


def _alike(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The pairs whose words have a similarity of SIMILARITY."""
    for batch in batches:
        batch = batch.drop_duplicates(["a", "b"])  # a pair comes once for each key that both have
        sets: dict[str, frozenset[str]] = {}
        for text in pd.concat([batch["text_a"], batch["text"]]):
            if text not in sets:
                sets[text] = _word_set(text)
        ok = []
        for one, two in zip(batch["text_a"], batch["text"]):
            both = len(sets[one] & sets[two])
            ok.append(both >= SIMILARITY * (len(sets[one]) + len(sets[two]) - both) - 1e-9)
        yield batch.loc[np.array(ok, bool), ["a", "b", "sim", "text"]]


def _probed(frontier: DataFrame) -> tuple[DataFrame, int, int, int]:
    """What :func:`_probes` gives of ``frontier``, written; how many sentences, keys and bytes of text these are."""
    probes = materialised(frontier.select("unit", "sim", "text").mapInPandas(_probes, "a long, sim_a long, text_a string, keys array<int>"))
    size = probes.agg(F.count("*"), F.sum(F.size("keys")), F.sum(F.octet_length("text_a"))).first()
    return probes, *(x or 0 for x in size)


def _near(frontier: DataFrame, rest: DataFrame) -> DataFrame:
    """``(a, b, sim, text)``: units of ``frontier`` and near-duplicate units of ``rest``, with these; a pair may come again."""
    return _looked_up(rest, *_probed(frontier))


def _looked_up(rest: DataFrame, probes: DataFrame, n: int, n_keys: int, text_bytes: int) -> DataFrame:
    """:func:`_near` of what :func:`_probed` gives.

    The words of each sentence are dealt to one part more than two near sentences
    can differ in, so near ones agree in a part: what shares the key of a part is
    compared, by SimHash distance, then by the Jaccard similarity of the words.
    The pairs of few sentences take their texts along, in one pass over ``rest``
    and without a shuffle; of many, the pairs are found before texts are joined.
    """
    by_key = probes.select("a", "sim_a", F.explode("keys").alias("key"))
    if 32 * n_keys <= BROADCAST:
        by_key = F.broadcast(by_key)
    texts = probes.select("a", "text_a")
    keyed = rest.select(F.col("unit").alias("b"), "sim", "text", F.explode("keys").alias("key"))
    close = F.bit_count(F.col("sim").bitwiseXOR(F.col("sim_a"))) <= DISTANCE
    pairs = keyed.join(by_key, "key").filter(close & F.expr("a <> b"))
    if 32 * n_keys <= BROADCAST and 40 * n + text_bytes <= BROADCAST:
        # Written first: Python workers then see the few pairs, not a task for each part of the rest.
        both = materialised(pairs.join(F.broadcast(texts), "a").select("a", "b", "sim", "text", "text_a"))
    else:
        pairs = materialised(pairs.select("a", "b").distinct())
        to = materialised(pairs.select(F.col("b").alias("unit")).distinct())
        there = materialised(rest.join(broadcast_if_small(to, 16), "unit", "left_semi").select(F.col("unit").alias("b"), "sim", "text"))
        both = pairs.join(texts, "a").join(there, "b")
    return both.select("a", "b", "sim", "text", "text_a").mapInPandas(_alike, "a long, b long, sim long, text string")


def residue_records(pages: DataFrame, id_col: str = "id", text_col: str = "content") -> DataFrame:
    """``(id, kinds)``: records with residue; kinds is a sum of 1 placeholder, 2 filler, 4 notice.

    The sentences of each record are labelled where patterns of unfilled
    placeholders, filler and notices leave no doubt; sentences that speak about
    such things are trusted to be clean.  Notices and filler are then looked up
    among all other sentences, by the parts of their words; candidates within
    DISTANCE SimHash bits that have a word similarity of SIMILARITY are linked, linked
    sentences are looked up in turn, and the labels are carried through the
    connected components of the links, except into components with a sentence
    that is trusted to be clean.  Placeholders are not carried on: a sentence
    without its placeholder is a good one.

    Null, empty and blank texts: no row.  Repeated rows: once.  Other columns
    are ignored; an empty table gives an empty result.
    """
    own = distinct_rows(pages.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), "id")
    units = materialised(own.filter("text is not null").mapInArrow(_unit_rows, _UNITS))
    seeded = units.filter("label <> 0").select("id", F.col("label").alias("kind"))
    parts = linked_units(units)
    carried = seeded.limit(0)
    if parts is not None:
        carried = units.filter("label = 0").select("id", "unit").join(broadcast_if_small(parts, 16), "unit").select("id", "kind")
    return seeded.unionByName(carried).groupBy("id").agg(F.bit_or("kind").alias("kinds"))


def _components(links: DataFrame) -> DataFrame:
    """:func:`connected_components` of ``links``, few of them in one task."""
    links = materialised(links.distinct())
    return connected_components(links) if links.limit(FEW_LINKS + 1).count() > FEW_LINKS else links.coalesce(1).mapInPandas(_join_links, "node long, component long")


def _join_links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    above: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := above.setdefault(x, x)) != x:
            above[x] = x = above.setdefault(up, up)
        return x

    for batch in batches:
        for a, b in zip(batch["a"].tolist(), batch["b"].tolist()):
            a, b = root(a), root(b)
            above[max(a, b)] = min(a, b)
    yield pd.DataFrame({"node": list(above), "component": [root(x) for x in above]}, dtype=np.int64)


def _joined(tables: list[DataFrame], n: int) -> DataFrame:
    """The units of ``tables``, ``n`` in all; few as one partition to broadcast."""
    units = reduce(DataFrame.unionByName, tables)
    return F.broadcast(units.coalesce(1)) if 16 * n <= BROADCAST else units


def linked_units(units: DataFrame) -> DataFrame | None:
    """``(unit, kind)``: sentences that the links connect with trusted residue, None without a link.

    ``units`` has ``(unit, label, sim, text, keys)``, the text null but once a unit
    or more often.  Each distinct sentence is looked up once, however many records
    have it, among all without a label, those linked already too.
    """
    each = units.filter("text is not null and sim <> 0").groupBy("unit").agg(
        F.max(F.struct("label", "text", "sim", "keys")).alias("u")
    )
    each = materialised(each.select("unit", "u.sim", "u.label", "u.text", "u.keys"))
    seeds = materialised(each.filter("label in (2, 4)").select("unit", "sim", "text", "label"))
    rest = each.filter("label = 0").select("unit", "sim", "text", "keys")
    found, done, n_done = [], [], 0
    probes, *size = _probed(seeds)
    while size[0]:  # ends: every hop takes sentences from the rest
        found.append(materialised(_looked_up(rest, probes, *size)))
        new = found[-1].select(F.col("b").alias("unit"), "sim", "text").dropDuplicates(["unit"])
        if done:
            new = new.join(_joined(done, n_done), "unit", "left_anti")
        probes, *size = _probed(new)
        done, n_done = [*done, probes.select(F.col("a").alias("unit"))], n_done + size[0]
        if len(done) > 3 and 16 * n_done <= BROADCAST:  # else each hop opens a file for each hop there was
            done = [materialised(_joined(done, n_done))]
    if not n_done:
        return None
    links = reduce(DataFrame.unionByName, [f.select("a", "b") for f in found])
    parts = materialised(_components(links))
    trusted = seeds.join(broadcast_if_small(parts, 16), seeds["unit"] == parts["node"]).groupBy("component").agg(F.max("label").alias("kind"))
    # Written first: else the pattern below would be pushed beneath the join, to every sentence.
    there = materialised(rest.join(broadcast_if_small(parts, 16), rest["unit"] == parts["node"]).join(trusted, "component"))
    clean = there.filter(F.col("text").rlike("(?i)" + MENTION.pattern)).select("component").distinct()
    return materialised(there.join(clean, "component", "left_anti").select("unit", "kind"))


def without_residue(pages: DataFrame, id_col: str = "id", text_col: str = "content") -> DataFrame:
    """The rows of ``pages`` that are no cases of :func:`residue_records`, all columns kept."""
    cases = residue_records(pages, id_col, text_col).select(F.col("id").alias("_case"))
    return pages.join(cases, pages[id_col] == F.col("_case"), "left_anti")
