"""Words of error pages, script notices and filler text (problem 2), page-local."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

# What error, block and outage pages and script, cookie, browser and check notices say, by language, in lower case.
_NOTICES = r"""
(?:enable|activate|allow|turn on|turned on|needs?|requires?|without|support for|switch(?:ed)? (?:on|off)|scripting switched).{0,40}\b(?:javascript|js|scripts?|scripting|cookies|off)\b
\b(?:javascript|js|scripts?|scripting|cookies|active content)\b.{0,40}\b(?:enable[d]?|required|turned (?:on|off)|switched (?:on|off)|disabled|is off|is needed|nothing to see)\b
\bif nothing happens, allow scripts\b
\b(?:your )?browser\b.{0,30}\b(?:too old|out of date|not supported|unsupported|blocks it)\b
\b(?:checking|verifying)\b.{0,30}\b(?:browser|connection)\b
\b(?:confirm|prove|verify)\b.{0,20}\b(?:human|robot|bot)\b
\ban ad ?blocker\b.{0,60}\b(?:stopped|turn)\b
\bredirecting you\b
^waiting for app\.\S+
\bjust a moment\b
\bpage (?:was )?not found\b|\bnot found$|^gone$|\bnot here any ?more\b|\bno forwarding address\b
\bmoved or never existed\b|\bnothing lives at this address\b|\bwe looked everywhere\b|\blink seems to be out of date\b
\bcontent is no longer available\b|\bthe owner removed it\b|\bno results\b|\bmatched no pages\b|^index of /|^parent directory$
\baccess denied\b|\bforbidden\b|\bnot allowed to open\b|\baddress has been blocked\b|\bnot available in your (?:country|region)\b
\baccount suspended\b|\bbilling desk\b|\blicen[sc]e expired\b|\bhosting plan\b|\bdomain parked\b|\bmay be for sale\b
\bserver error\b|\bbad gateway\b|\bgateway time-?out\b|\btimed out\b|\bservice (?:is )?(?:temporarily )?unavailable\b|\btoo many requests\b
\breached the limit\b|\bserver met a problem\b|\bsomething went wrong\b|\bit's not you, it's us\b|\bupstream host\b|\bnobody picked up\b
\bbad request\b|\bunhandled exception\b|^fatal:|^fatal error|^warning: .{0,60}\.(?:inc|php|tpl)\b|\bat [\w.]+\(\S+:\d+\)|\bestablishing a database connection\b
\bdown for (?:scheduled )?maintenance\b|\bbe back soon\b|\bservice is resting\b|\bplease log in\b|\bmust be signed in\b|\bsession expired\b|\bsign in again\b
\bjavascript\b.{0,30}\baktivieren\b|\baktivieren sie\b.{0,20}\b(?:javascript|cookies)\b|\bbraucht skripte\b|\bbrowser wird geprüft\b|\bbrowser ist (?:zu alt|veraltet)\b
\bnichts gefunden\b|\bnicht gefunden\b|\bgesuchte seite\b|\bleider nichts da\b|\bunter dieser adresse\b|\bzugriff verweigert\b|\banmeldung erforderlich\b|\bbitte melden sie sich an\b
^fehler \d+|\bserver ist etwas schiefgelaufen\b|\bverbindung abgelaufen\b|\bdienst antwortet nicht\b|\bzu viele anfragen\b|\bdatenbank nicht erreichbar\b|\bwartungsarbeiten\b|\bin kürze wieder da\b|\bsitzung abgelaufen\b
\bactivez (?:javascript|les cookies)\b|\bbesoin de scripts\b|\bvérification de votre navigateur\b|\bnavigateur (?:est )?trop ancien\b
\bpage introuvable\b|\badresse ne mène à rien\b|\baccès refusé\b|\bconnexion requise\b|\bidentifiez-vous pour voir\b|\bsession expirée\b
\berreur (?:interne|\d+)\b|\bserveur n'a pas pu\b|\bdélai dépassé\b|\bservice ne répond plus\b|\btrop de requêtes\b|\bquelque chose n'a pas marché\b|\bsite en maintenance\b|\brevient bientôt\b|\bcontenu (?:retiré|supprimé)\b
\bactive (?:javascript|las cookies)\b|\bnecesita scripts\b|\bcomprobando su navegador\b|\bnavegador (?:es )?demasiado antiguo\b
\bpágina no encontrada\b|\bno existe o cambió de lugar\b|\bacceso denegado\b|\binicie sesión para\b|\bdebe iniciar sesión\b|\bsesión caducada\b
\berror (?:interno|\d+)\b|\bservidor no pudo\b|\btiempo agotado\b|\bservicio no responde\b|\bdemasiadas (?:solicitudes|peticiones)\b|\balgo salió mal\b|\ben mantenimiento\b|\bvolverá pronto\b|\bcontenido retirado\b|\bborró esta página\b
\bвключите (?:javascript|cookies|скрипты)\b|\bпроверяем ваш браузер\b|\bстраница не найдена\b|\bтакого адреса больше нет\b|\bдоступ запрещён\b|\bдоступ запрещен\b|\bтребуется вход\b
\bошибка (?:сервера|\d+)\b|\bповторите попытку\b|\bслишком много запросов\b|\bведутся работы\b|\bскоро вернётся\b|\bчто-то пошло не так\b|\bсервис не отвечает\b
javascriptを有効に|cookieを有効に|ブラウザを確認して|ページが見つかりません|移動または削除されました|アクセスが拒否され|メンテナンス中|ログインが必要|サーバーエラー|エラーが発生|しばらくお待ちください|しばらくしてから
请(?:启用|开启|打开).{0,6}(?:javascript|脚本|cookie)|正在检查.{0,6}浏览器|(?:页面|网页)(?:不存在|未找到)|找不到.{0,6}(?:页面|网页)|访问被拒绝|服务器(?:内部)?错误|维护中|请求过多|请先登录|请稍后再试
يرجى تفعيل|الصفحة غير موجودة|تم رفض الوصول|خطأ في الخادم|تحت الصيانة|تسجيل الدخول مطلوب|جافا ?سكريبت
जावास्क्रिप्ट|पृष्ठ नहीं मिला|पन्ना नहीं मिला|पहुँच अस्वीकृत|सर्वर त्रुटि|रखरखाव|लॉग ?इन करें
เปิดใช้งาน\s?(?:javascript|จาวาสคริปต์)|ไม่พบหน้า|การเข้าถึงถูกปฏิเสธ|ข้อผิดพลาดของเซิร์ฟเวอร์|ปิดปรับปรุง|โปรดเข้าสู่ระบบ
"""
_CODE_ONLY = re.compile(r"^(?:error |fehler |erreur |http )?(?:40[0-9]|410|418|429|451|50[0-9]|52[0-9])\b[ .:–-]*$", re.I)
_CODES = re.compile(r"40[0-9]|410|418|429|451|50[0-9]|52[0-9]")
_QUANTIFIED = re.compile(r"[?*+]|\{[^}]*\}")


def _split(pattern: str) -> list[str]:
    """The alternatives of a pattern, outside its groups and classes."""
    out, depth, at, i = [], 0, 0, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 1
        elif c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
        elif c == "|" and not depth:
            out.append(pattern[at:i])
            at = i + 1
        i += 1
    return [*out, pattern[at:]]


def needles_of(pattern: str) -> list[str]:
    """Strings of which every match of the pattern (one alternative, lower case) holds at least one; empty where none are plain."""
    runs: list[list[str]] = []  # every entry: strings of which one must be there
    run, i = "", 0
    while i < len(pattern):
        c, group = pattern[i], None
        if c == "\\":
            plain = pattern[i + 1] if pattern[i + 1] in ".()" else None
            i += 2
        elif c == "(":
            end = i
            depth = 0
            while True:
                depth += {"(": 1, ")": -1}.get(pattern[end], 0)
                end += 1
                if not depth:
                    break
            group, plain = pattern[i + 3 : end - 1], None
            i = end
        elif c == "[":
            plain, i = None, pattern.index("]", i) + 1
        else:
            plain = None if c in ".^$" else c
            i += 1
        m = _QUANTIFIED.match(pattern, i)
        if m:
            i, plain = m.end(), None
        if plain is not None:
            run += plain
            continue
        runs.append([run])
        run = ""
        if group is not None and not (m and (m[0][0] in "?*" or m[0].startswith("{0"))):
            inner = [needles_of(x) for x in _split(group)]
            if all(inner):
                runs.append([y for x in inner for y in x])
    runs.append([run])
    best = max(runs, key=lambda r: min(map(len, r)))
    return best if min(map(len, best)) > 1 else []


class Finder:
    """Many lower-case patterns at once: one pass over the text finds the plain strings in it, and only the patterns with one of them are tried."""

    def __init__(self, *patterns: str):
        alternatives = [y for x in patterns for y in _split(x)]
        self.compiled = [re.compile(x) for x in alternatives]
        self.needles: dict[str, list[int]] = {}
        for i, x in enumerate(alternatives):
            found = needles_of(x)
            if not found:
                raise ValueError(f"a pattern without a plain string: {x}")
            for n in found:
                self.needles.setdefault(n, []).append(i)
        try:
            import ahocorasick
        except ImportError:
            self.automaton = None
        else:
            self.automaton = ahocorasick.Automaton()
            for n, which in self.needles.items():
                self.automaton.add_word(n, which)
            self.automaton.make_automaton()

    def _met(self, low: str) -> Iterator[list[int]]:
        if self.automaton is None:
            return (which for n, which in self.needles.items() if n in low)
        return (which for _, which in self.automaton.iter(low))

    def may(self, low: str) -> bool:
        """False only where no part of the text matches."""
        return next(self._met(low), None) is not None

    def search(self, low: str) -> bool:
        """Whether a pattern matches in the lower-case text."""
        tried: set[int] = set()
        for which in self._met(low):
            for i in which:
                if i not in tried:
                    tried.add(i)
                    if self.compiled[i].search(low):
                        return True
        return False


@functools.cache
def _notices() -> Finder:
    return Finder(*_NOTICES.strip().split("\n"))


@functools.cache
def _fillers() -> Finder:
    return Finder(_FILLER)


@functools.cache
def _told() -> Finder:
    return Finder(_FILLER, *sorted(_TOLD))


def _low(text: str) -> str:
    return text.lower().replace("’", "'")


def may_hold_notice(text: str) -> bool:
    """False only where no part of the text can be a notice."""
    return _notices().may(_low(text)) or _CODES.search(text) is not None


# Words of pseudo-Latin filler.
LOREM = frozenset(
    "lorem ipsum dolor sit amet consectetur adipiscing adipisicing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad "
    "minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit "
    "esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum "
    "vestibulum ante primis faucibus orci luctus ultrices posuere cubilia curae vivamus pellentesque habitant morbi tristique senectus netus "
    "malesuada fames ac turpis egestas porta vitae justo nec odio donec quam felis ultricies mauris integer nunc viverra tempus datum dolis velo vexo "
    "fenis fira tarim serum nomar minal pellum utrum obel curabo elis".split()
)
# What repeated filler says.
_FILLER = (
    r"(?:sample|dummy|placeholder|filler|blind|example) (?:text|copy|content|paragraph)|placeholder (?:text|paragraph)|blindtext|platzhalter|fülltext|texto de (?:relleno|ejemplo|prueba)|"
    r"texte (?:de remplissage|factice|d'exemple)|faux[- ]texte|текст[- ](?:заполнитель|рыба|заглушка)|рыба[- ]текст|пример текста|ダミー(?:テキスト|文)|サンプルテキスト|占位(?:文本|文字)|示例文(?:本|字)|填充文(?:本|字)|"
    r"نص تجريبي|نص وهمي|नमूना पाठ|ข้อความตัวอย่าง|ข้อความจำลอง"
)
#: Of these, words that other languages share say nothing alone.
_SHARED = frozenset("a ad amet ante culpa do dolor duis ea elis est et eu ex fames id in nisi non odio quam quis sed sit sunt tempus ut vitae".split())
_TOLD = LOREM - _SHARED
_WORD = re.compile(r"[^\W\d_]+")
_SENTENCES = re.compile(r"(?<=[.!?।])\s+|(?<=[。！？])")
_ENDS = ".!?。！？।"
_STOPS = re.compile(f"[{_ENDS}]+")


def is_notice(text: str) -> bool:
    return _notices().search(_low(text)) or bool(_CODE_ONLY.match(text))


def notice_line(text: str) -> bool:
    """Whether a line of any length is a notice: most of its sentences are, so that prose which mentions one is none."""
    if not is_notice(text):
        return False
    parts = [x for x in _SENTENCES.split(text) if x.strip()]
    return 2 * sum(len(x) for x in parts if is_notice(x.strip())) >= len("".join(parts))


def may_hold_filler(text: str) -> bool:
    """False only where no line of the text can be pseudo-Latin or name itself filler."""
    return _told().may(text.lower())


def is_filler(text: str, told: bool = True) -> bool:
    """Pseudo-Latin, or the same sentence again and again, or a short line that names itself filler.

    ``told`` says that ``may_hold_filler`` holds for the text around, so that only repetition is left to look for where it does not.
    """
    words: list[str] = []
    if told:
        words = _WORD.findall(text.lower())
        if len(words) >= 4 and not _SHARED.issuperset(words) and sum(w in LOREM for w in words) >= 0.6 * len(words):
            return True
    if sum(map(text.count, _ENDS)) >= 2:
        parts = [x.strip().lower() for x in _STOPS.split(text) if x.strip()]
        if len(parts) >= 3 and len(set(parts)) <= len(parts) // 3:
            return True
        if len(parts) > 1:
            return False
    return told and len(text) < 60 and len(words) <= 6 and _fillers().search(text.lower()) and sum(bool(x.strip()) for x in _STOPS.split(text)) <= 1
