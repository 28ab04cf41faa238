"""Template residue and error-page text: character n-gram models, likelihood-ratio windows, exclusion by coverage."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from http import HTTPStatus

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beliefloom import session

ORDERS, BINS = 5, 1 << 17
#: Characters of a likelihood-ratio window; share of the content that residue must cover; least characters of content.
WINDOW, COVERAGE, LEAST = 21, 0.55, 8
#: By how much the log likelihood of residue must exceed that of prose in a window.
MARGIN = 2.0
#: Characters of a window for fields, and by how much the log likelihood of a field must exceed that of prose in it.
FIELD_WINDOW, FIELD_RATIO = 7, 0.0
CLASSES = ("natural", "filler", "notice")
FIELD = 3

# Seed texts that the models of filler, error notices and natural prose start from; what documents say besides
# is learned from all of them (see fit).
FILLER = """
Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua.
Ut enim ad minim veniam, quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat.
Duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur.
Excepteur sint occaecat cupidatat non proident, sunt in culpa qui officia deserunt mollit anim id est laborum.
Your text goes here. Enter some text here. Add a short description of the product here. Write a few words about yourself here.
This is a sample paragraph used only to fill the layout. This is placeholder text for the design. It will be replaced by real content.
Replace this with your own content. Replace this paragraph before going live. Final copy to be written. Real text to come later.
Content coming soon. Text to follow. Copy to be supplied. Body text goes in this space. Type the main message here. Headline goes here.
Dummy text. Sample text only. Filler text. Just some example words so that the column looks full. Insert a paragraph about the topic.
blah blah blah blah. bla bla bla. test test test test. text text text. xxx xxx xxx. foo bar baz qux. asdf asdf asdf jkl. qwerty qwerty. abc abc abc. word word word.
Hier steht ein Beispieltext. Dies ist nur ein Blindtext. Platzhalter für Ihren Text. Hier folgt später der eigentliche Inhalt. Fügen Sie hier Ihren Text ein.
Ceci est un texte d'exemple. Ajoutez votre texte ici. Texte de remplacement, à modifier plus tard. Le contenu définitif suivra.
Este es un texto de ejemplo. Escriba su texto aquí. Texto de relleno que se cambiará más tarde. El contenido final vendrá después.
"""
NOTICE = """
The page you are looking for cannot be found or has been removed. We could not find what you were looking for. There is nothing at this address.
The link you followed may be out of date. This content has moved or is no longer here. Check the spelling of the address or go back to the start page.
Sorry, something went wrong on our side. Oops, an unexpected error has occurred. We have been told about it. Please try again later.
Please wait a few minutes and try again. Try reloading the page. If this keeps happening, contact support and quote the reference number. Error code 0. Request id 0.
The server is temporarily unable to handle your request because of maintenance or overload. This service is down for scheduled maintenance. We will be back soon.
The server encountered an error and could not complete your request. The server did not respond in time. Timed out while waiting for the upstream server. Connection to 0 refused.
You are not allowed to open this page. You do not have permission to access this document. Access denied. Access to this site has been blocked. Your request was blocked for security reasons.
Your session has ended. Please log in again. You have sent too many requests, slow down. You have used up your free articles. Subscribe to read more.
The connection to the database could not be established. Database error. Could not connect to host 0. Name or address not known. Cannot resolve the host name.
Traceback (most recent call last): File "main.py", line 0, in handler raise RuntimeError: bad state. ValueError: not a number. KeyError: 'id'. TypeError: unsupported operand.
Exception in thread "main" java.lang.RuntimeException: null at Main.run(0). Unhandled exception. Stack trace: at index 0. Fatal error: call to undefined function on line 0. Segmentation fault (core dumped).
Die gesuchte Seite konnte nicht gefunden werden. Diese Seite gibt es nicht mehr. Es ist ein unerwarteter Fehler aufgetreten. Der Server ist vorübergehend nicht erreichbar. Fehler 0.
Sie haben keine Berechtigung für diese Seite. Zugriff verweigert. Bitte laden Sie die Seite neu. Ihre Anfrage konnte nicht verarbeitet werden. Versuchen Sie es in einigen Minuten noch einmal.
La page que vous cherchez est introuvable. Erreur 0. Une erreur inattendue s'est produite. Le serveur ne répond pas, réessayez plus tard. Le service est momentanément indisponible.
Vous n'êtes pas autorisé à consulter cette page. Accès refusé. Votre demande n'a pas pu être traitée. Rechargez la page ou vérifiez l'adresse.
La página que busca no existe o ha sido eliminada. Error 0. Se produjo un error inesperado en el servidor. El servicio no está disponible en este momento. Vuelva a intentarlo más tarde.
No tiene permiso para ver esta página. Acceso denegado. No se pudo procesar su solicitud. Recargue la página o compruebe la dirección.
To use this website you must enable JavaScript. This application requires JavaScript in order to work. JavaScript is turned off in your browser. JavaScript seems to be disabled or blocked.
Turn on scripts in your browser settings and refresh the page. You need to allow scripts to view this content. Without JavaScript this page cannot be shown. Please switch on scripting and cookies.
This site does not work properly without scripts. Please wait while we verify your browser. Please allow cookies and scripts for this site. Scripts and cookies must be enabled. Nothing is displayed unless scripting is enabled. Loading, please wait. Some features are not available while scripting is off.
Bitte JavaScript im Browser aktivieren, um diese Seite zu nutzen. Diese Anwendung funktioniert nur mit JavaScript. Scripts müssen erlaubt sein, damit der Inhalt angezeigt wird. JavaScript ist ausgeschaltet.
Activez JavaScript dans votre navigateur pour utiliser ce site. Cette application nécessite JavaScript. Vous devez autoriser les scripts pour voir le contenu. JavaScript est désactivé.
Para usar este sitio debe habilitar JavaScript en su navegador. Esta aplicación necesita JavaScript. Debe permitir los scripts para ver el contenido. JavaScript está desactivado.
"""
NATURAL = """
The committee met on Tuesday and asked the engineer to measure the level again before the end of the month.
Support for the claim comes from two reports, and both of them were written after the audit in spring.
A sample was sent to the laboratory, which found traces of rust and recommended another test in the autumn.
The error rate fell by half after the server moved, and the number of requests that were denied fell as well.
When the gateway was down, the desk kept the last good copy of the page and noted the delay in the log.
The manual explains how to turn scripts on, why the template has a gap and what the placeholder stands for.
She walked to the station in the rain because the bus had not come, and missed the train by two minutes.
Most of the houses on the hill were built of brick, with low windows and a garden that ran down to the river.
He said that prices had risen for the third year, although the harvest was good and the roads were open again.
In the winter of that year the lake froze early, and the fishermen carried their boats over the ice to the village.
We compared the two methods on the same data and found that the simpler one was faster but less exact for small values.
The museum keeps letters, maps and drawings from the first voyage; few of them have been shown to visitors so far.
Nobody knew who had opened the box, when it was moved from the cellar, or whether the key had been copied before.
According to the paper, the council will decide next week if the old bridge is repaired or replaced by a tunnel.
They had planned to leave at noon, but one of the engines would not start and the captain sent for another part.
It is cheaper to store the grain dry than to cool it, which is why the farms here dry it as soon as it is cut.
The teacher read the story aloud and then asked the children what they thought the old man wanted to say with it.
After a long talk the two sides agreed on a lower fee, a later date and a clause that lets either of them withdraw.
You can see the tower from the coast on a clear day, yet hardly anyone climbs it since the path was washed away.
There were more birds than last summer, according to the warden, and most of the nests on the island had eggs in them.
Der Bericht wurde nach der Prüfung geändert, weil zwei Messwerte fehlten. Die Stadt hat das Haus gekauft und will es im nächsten Jahr als Schule nutzen.
Am Abend gingen sie noch einmal zum Hafen, sahen den Schiffen zu und sprachen über die Reise, die am Morgen beginnen sollte.
Le rapport a été modifié après la révision. La ville a acheté la maison et veut en faire une école dès l'année prochaine, selon le maire.
Le soir, ils sont retournés au port pour regarder les bateaux et parler du voyage qui devait commencer le lendemain matin.
El informe fue corregido tras la revisión. La ciudad compró la casa y quiere usarla como escuela a partir del próximo año, según el alcalde.
Por la tarde volvieron al puerto para mirar los barcos y hablar del viaje que debía empezar a la mañana siguiente.
"""
#: Names of the fields of templates, and how templates mark a field.
FIELD_NAMES = "name first_name last-name user email company title subject headline date time city address phone amount price number order.id link url text body author writer topic value item code region label"
FIELD_MARKS = "{{ x }} {{x}} {{{x}}} {{#x}} {{x|default}} {%x%} {%-x-%} ${x} #{x} <%=x%> %(x)s %%x%% @@x@@ [[x]] <<x>> $x$ __x__ {x} <x> {0} %s %d [insert/x] [your/x] [x/tbd] [tbd] [x/name] (fill/in/x) <insert/x>"
#: Lines of navigation and footers, which are no content.
FURNITURE = re.compile(
    r"^(©|\(c\)|copyright\b|powered by\b|skip to\b|share this\b|back to (the )?(start|top|home)\b|all rights reserved"
    r"|cookie (settings|policy|preferences)$|menu\b.{0,40}$|home\s*[|›>·]|terms\b|privacy\b|imprint\b|sign in\b|log in\b|follow us\b|subscribe\b|#{1,6}\s)", re.I,
)
#: Lines that are navigation or footers too, unless the models take them for a notice.
DOUBTFUL = re.compile(r"^cookie(s| settings)\b|^[^.!?]{1,30}(\s[|·•›]\s[^.!?|·•›]{1,30})+$", re.I)
#: Elements of HTML that are not template fields.
_TAGS = "a|abbr|article|aside|b|blockquote|body|br|button|code|dd|div|dl|dt|em|footer|form|h[1-6]|head|header|hr|html|i|img|input|li|link|main|meta|nav|ol|p|pre|script|span|strong|style|sub|sup|table|tbody|td|th|thead|title|tr|u|ul|no"
_NAME = r"[A-Za-z][\w.\- ]{0,40}"
_FIELD = r"[A-Za-z][\w.\-]{0,40}"
#: The delimiters of unfilled fields.
PLACEHOLDER = re.compile(
    rf"\{{\{{\{{?\s*{_NAME}(?:\|[^{{}}\n]{{1,80}})?\s*\}}?\}}\}}|\{{\{{[#/^>&]\s*{_NAME}\s*\}}\}}|\$\{{\s*{_FIELD}\s*\}}|#\{{\s*{_FIELD}\s*\}}|<%=\s*{_FIELD}\s*%>|\{{%-?\s*[A-Za-z][^{{}}%\n]{{0,80}}%\}}"
    rf"|%\({_FIELD}\)[sd]|(?<![\w%])%[sd](?![\w%])|%%[A-Za-z][\w.\-]*%%|@@{_FIELD}@@|\[\[\s*{_FIELD}\s*\]\]|<<\s*{_NAME}\s*>>"
    rf"|\$[A-Z][A-Z_.\-]*\$|(?<!\w)__[A-Z][A-Z_.\-]*__(?!\w)|\[(?i:insert)\s+{_NAME}\]|\[{_NAME}\s+(?i:TBD)\]|\[(?i:TBD)\]|\[(?i:your)\s+{_NAME}\]"
    rf"|\[(?:[A-Z][a-z]+ ){{1,3}}(?:Name|Date|Address|Title|Number|Email|Phone|City)\](?!\()"
    rf"|\((?i:fill in)\s+{_NAME}\)|<(?i:insert)\s+{_NAME}>|(?<![\w{{$#])\{{(?:\d+|{_FIELD})\}}(?!\}})|<(?!(?:{_TAGS})>)[a-z]+(?: [a-z]+){{0,3}}>",
    re.A,
)
_CODE = re.compile(r"```.*?(?:```|\Z)|~~~.*?(?:~~~|\Z)", re.S)
_QUOTED = re.compile(r"`[^`\n]*`|\"[^\"\n]{1,200}\"|“[^”\n]{1,200}”|„[^“”\n]{1,200}[“”]|«[^»\n]{1,200}»")


def _fields(text: str) -> list[tuple[int, str]]:
    """(line, field) of the marked fields that stand where a value belongs: not in code, quotation marks or quoted lines."""
    if not any(c in text for c in _MARKS):
        return []
    t = _QUOTED.sub(" ", _CODE.sub(lambda m: "\n" * m.group().count("\n"), text.replace("\r", "")))
    found = [(i, m) for i, x in enumerate(t.split("\n")) if not x.lstrip().startswith(">") for m in PLACEHOLDER.findall(x)]
    return [(i, m) for i, m in found if not (m[0] == "<" and f"</{m[1:]}" in text)]


def unfilled(text: str) -> list[str]:
    return [m for _, m in _fields(text)]


_MARKS = "{}<>[]%@$_("
_IDS = re.compile(r"\b(?:(?=\w*\d)[\w#.\-]*\w|\w[\w\-]*(?:\.\w[\w\-]*)+)\b")

_BLANKS = re.compile(r"[ \t\xa0]{2,}|[\t\xa0]")


def normal(text: str) -> str:
    """Lower case, each token with a digit or inner dots (numbers, ids, hosts) as 0, runs of blanks as one."""
    return _BLANKS.sub(" ", _IDS.sub("0", text.lower().replace("\r", "")))


def _bins(text: str) -> list[np.ndarray]:
    """For each order, the bin of the n-gram that ends at each character."""
    c = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    h, out = c.copy(), []
    for k in range(ORDERS):
        if k:
            h *= np.uint64(0x100000001B3)
            h[k:] ^= c[:-k] + np.uint64(k * 0x9E3779B9)
        out.append((((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(40)) % np.uint64(BINS)).astype(np.int32))
    return out


#: Between lines, so that no n-gram reaches from one line into the next.
_GAP = "\n" * (ORDERS - 1)


class Lines:
    """The lines of some texts in normal form.

    raw: characters of a line as it stands; furniture: headings, navigation and footers, which are no content; doubt: lines that are content only if they are a
    notice; marked: lines that hold a character with which a field may begin.
    """

    def __init__(self, texts: Sequence[str | None]):
        self.lines: list[str] = []
        doc, row, furniture, raw = [], [], [], []
        for i, t in enumerate(texts):
            for k, line in enumerate((t or "").replace("\r", "").split("\n")):
                x = normal(line).strip()
                if x:
                    self.lines.append(x)
                    raw.append(len(line.strip()))
                    doc.append(i)
                    row.append(k)
                    furniture.append(bool(FURNITURE.search(x)))
        self.doc, self.row, self.raw, self.furniture = np.array(doc, np.int64), np.array(row, np.int64), np.array(raw, np.int64), np.array(furniture, bool)
        self.doubt = np.array([bool(DOUBTFUL.search(x)) for x in self.lines], bool)
        self.marked = np.array([any(c in x for c in _MARKS) for x in self.lines], bool)
        self.size = np.array([len(x) for x in self.lines], np.int64)
        self.whole = _GAP + _GAP.join(self.lines) + _GAP
        self.start = len(_GAP) + np.concatenate([[0], np.cumsum(self.size[:-1] + len(_GAP))]) if self.lines else np.zeros(0, np.int64)


def spread(size: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(line, place) of every character of lines of these sizes and starts."""
    line = np.repeat(np.arange(len(size)), size)
    return line, np.arange(len(line)) - np.repeat(np.cumsum(size) - size, size) + start[line]


def blocks(texts: Sequence[str | None], most: int = 1 << 16) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about ``most`` characters together (one text may have more)."""
    lo = chars = 0
    for i, t in enumerate(texts):
        chars += len(t or "")
        if chars >= most:
            yield lo, i + 1
            lo, chars = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def gram_counts(lines: Sequence[str]) -> np.ndarray:
    out = np.zeros((ORDERS, BINS), np.float64)
    if lines:
        for n, b in enumerate(_bins(_GAP + _GAP.join(lines))):
            out[n] = np.bincount(b, minlength=BINS)
    return out


_ALNUM = np.array([chr(i).isalnum() for i in range(0x10000)])


class Model:
    """Interpolated character n-gram models of the classes and of template fields, over hashed counts."""

    def __init__(self, counts: Sequence[np.ndarray]):
        self.counts = [c.astype(np.float32) for c in counts]
        self.total = [max(float(c[0].sum()), 1.0) for c in counts]

    def log(self, text: str, classes: Sequence[int] = (0, 1, 2), bins: list[np.ndarray] | None = None) -> np.ndarray:
        """(classes, characters): log probability of each character after those before it; bins: those of the text, if known."""
        bins = bins or _bins(text)
        out = np.empty((len(classes), len(text)), np.float32)
        for row, k in enumerate(classes):
            c, total = self.counts[k], self.total[k]
            seen = c[0][bins[0]]
            p = (seen + np.float32(0.5)) / np.float32(total + 100)
            for n in range(1, ORDERS):
                hit = c[n][bins[n]]
                before = np.empty_like(seen)
                before[0], before[1:] = 0, seen[:-1]
                before = np.maximum(before, hit)
                # What a context leaves for unseen characters shrinks as the root of its count, so that a model of much
                # text does not rule out new words that one of little text would let pass.
                rest = 2 * np.sqrt(before + 1)
                p = (hit + rest * p) / (before + rest)
                seen = hit
            np.log(p, out=out[row])
        return out

    def sums(self, ln: Lines, bins: list[np.ndarray] | None = None) -> np.ndarray:
        """(classes, characters + 1): running sums of the log probabilities of all lines."""
        out = np.zeros((len(CLASSES), len(ln.whole) + 1))
        np.cumsum(self.log(ln.whole, bins=bins), axis=1, dtype=np.float64, out=out[:, 1:])
        return out

    def field_lines(self, ln: Lines, natural: np.ndarray) -> np.ndarray:
        """Numbers of the lines with a window in which a field is likelier than prose; natural: its running sums."""
        at = np.flatnonzero(ln.marked)
        if not len(at):
            return at
        size = ln.size[at]
        start = len(_GAP) + np.cumsum(size + len(_GAP)) - size - len(_GAP)
        own = np.concatenate([[0], np.cumsum(self.log(_GAP + _GAP.join(ln.lines[i] for i in at), (FIELD,))[0], dtype=np.float64)])
        line, place = spread(size, start)
        a = np.maximum(place - FIELD_WINDOW // 2, start[line])
        e = np.minimum(place + FIELD_WINDOW // 2 + 1, (start + size)[line])
        there = ln.start[at][line] - start[line]
        hit = own[e] - own[a] - (natural[e + there] - natural[a + there]) >= FIELD_RATIO
        return at[np.unique(line[hit])]

    def judge(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(texts, classes): letters of prose, filler and notices in each text; (texts): unfilled fields; characters of content."""
        out, fields, content = np.zeros((len(texts), len(CLASSES)), np.int64), np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        for lo, hi in blocks(texts):
            ln = Lines(texts[lo:hi])
            if not ln.lines:
                continue
            sums = self.sums(ln)
            likely: dict[int, set[int]] = {}
            for i in self.field_lines(ln, sums[0]):
                likely.setdefault(int(ln.doc[i]), set()).add(int(ln.row[i]))
            for doc, rows in likely.items():
                fields[lo + doc] = sum(row in rows for row, _ in _fields(texts[lo + doc] or ""))
            n = self.letters(ln, sums)
            np.add.at(out, lo + ln.doc, n)
            np.add.at(content, lo + ln.doc, np.where(n.any(axis=1), ln.raw, 0))
        return out, fields, content

    def letters(self, ln: Lines, sums: np.ndarray) -> np.ndarray:
        """(lines, classes): letters of each class in the lines that are content."""
        line, at = spread(ln.size, ln.start)
        code = np.frombuffer(ln.whole.encode("utf-32-le"), np.uint32)[at]
        keep = _ALNUM[np.minimum(code, 0xFFFF)] | (code > 0xFFFF)
        line, at = line[keep], at[keep]
        a = np.maximum(at - WINDOW // 2, ln.start[line])
        e = np.minimum(at + WINDOW // 2 + 1, ln.start[line] + ln.size[line])
        best = np.argmax(sums[:, e] - sums[:, a] + np.array([[MARGIN], [0], [0]]), axis=0)
        n = np.bincount(line * 3 + best, minlength=3 * len(ln.lines)).reshape(-1, 3)
        # A line that is nearly all residue is residue with the names in it.
        nearly = n[:, 1] + n[:, 2] >= 0.8 * n.sum(axis=1)
        more = np.where(nearly, n[:, 0], 0)
        filler = n[:, 1] >= n[:, 2]
        n[:, 0] -= more
        n[:, 1] += np.where(filler, more, 0)
        n[:, 2] += np.where(filler, 0, more)
        n[ln.furniture | (ln.doubt & ~(nearly & ~filler))] = 0
        return n


def _seed(lines: Sequence[str]) -> np.ndarray:
    return gram_counts([normal(x).strip() for x in lines if x.strip()])


def _status_lines() -> list[str]:
    """Error notices as servers word them, for every status that HTTP defines."""
    out = []
    for s in (s for s in HTTPStatus if s >= 400):
        out += [f"{s.value} {s.phrase}", f"Error {s.value}: {s.phrase}.", f"HTTP Status {s.value} – {s.phrase}.", f"{s.phrase} ({s.value}).", f"{s.phrase}. {s.description}."]
        out += [f'{{"error": {{"code": {s.value}, "message": "{s.phrase}"}}}}', f"<html><head><title>{s.value} {s.phrase}</title></head><body><h1>{s.phrase}</h1><hr></body></html>"]
    return out


def _field_seeds() -> list[str]:
    """Every mark around every name, set in text."""
    marks = [m.replace("/", " ") for m in FIELD_MARKS.split()]
    return [f" {m.replace('x', n) if 'x' in m else m}{end}" for m in marks for n in FIELD_NAMES.split() for end in (" ", ",", ".")]


def seed_counts() -> list[np.ndarray]:
    return [_seed(NATURAL.splitlines()), _seed(FILLER.splitlines()), _seed(NOTICE.splitlines() + _status_lines()), _seed(_field_seeds())]


#: Characters that the counts of prose and of each kind of residue are scaled to.
MASS, LEARNT = 1_000_000, 20_000
#: Log likelihood per character by which residue must beat prose for a line to count as residue when the models are
#: fitted: first against the seed of prose, then against prose as counted so far.
SURE = (0.7, 0.4, 0.4)
#: Share of the letters of a text from which on, when the models are fitted, its other lines count as residue of that kind too.
MOSTLY = 0.5


def packed(counts: Sequence[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Counts without their zeros, to be sent."""
    return [((at := np.flatnonzero(c.ravel())).astype(np.int32), c.ravel()[at].astype(np.float32)) for c in counts]


def unpacked(parts: Sequence[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    out = np.zeros((len(parts), ORDERS * BINS), np.float32)
    for c, (at, n) in zip(out, parts):
        c[at] = n
    return [c.reshape(ORDERS, BINS) for c in out]


class _Grams:
    """Counts of the n-grams of lines, by class; each line counts with the gap after it, so blocks make no difference."""

    def __init__(self):
        self.total = np.zeros((ORDERS, len(CLASSES) * BINS), np.int64)
        self.parts: list[list[np.ndarray]] = []
        self.size = 0

    def add(self, ln: Lines, bins: list[np.ndarray], label: np.ndarray) -> None:
        """label: class of each line, or -1."""
        at = np.repeat(label, ln.size + len(_GAP))
        some = np.flatnonzero(at >= 0)
        base = (at[some] * BINS).astype(np.int32)
        self.parts.append([base + b[len(_GAP) :][some] for b in bins])
        self.size += len(some)
        if self.size >= 1 << 20:
            self.counts()

    def counts(self) -> np.ndarray:
        """(classes, ORDERS, BINS)"""
        for n in range(ORDERS if self.parts else 0):
            self.total[n] += np.bincount(np.concatenate([p[n] for p in self.parts]), minlength=self.total.shape[1])
        self.parts, self.size = [], 0
        return self.total.reshape(ORDERS, len(CLASSES), BINS).swapaxes(0, 1)


def _count(shared, sure: float, learn: bool):
    """mapInArrow over text: class, bin, n of the n-grams in the lines of prose and, with learn, of residue."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(unpacked(shared.value))
        grams = _Grams()
        for b in batches:
            texts = b.column("text").to_pylist()
            for lo, hi in blocks(texts):
                ln = Lines(texts[lo:hi])
                if not ln.lines:
                    continue
                bins = _bins(ln.whole)
                sums = m.sums(ln, bins)
                s = sums[:, ln.start + ln.size] - sums[:, ln.start]
                best = np.where(s[1] >= s[2], 1, 2)
                bad = np.maximum(s[1], s[2]) - s[0] >= sure * ln.size
                empty = {(i, row) for i in np.unique(ln.doc[ln.marked]) for row, _ in _fields(texts[lo + i] or "")}
                if learn:
                    n = np.zeros((hi - lo, len(CLASSES)), np.int64)
                    np.add.at(n, ln.doc, m.letters(ln, sums))
                    mostly = (n[:, 1] + n[:, 2] >= MOSTLY * n.sum(axis=1)) & (n[:, 1] + n[:, 2] > 0)
                    best = np.where(mostly[ln.doc], np.where(n[:, 1] >= n[:, 2], 1, 2)[ln.doc], best)
                    bad |= mostly[ln.doc]
                skip = ln.doubt | ln.furniture | np.array([(d, r) in empty for d, r in zip(ln.doc, ln.row)], bool)
                grams.add(ln, bins, np.where(skip, -1, np.where(~bad, 0, np.where(learn & (ln.size >= LEAST), best, -1))))
        total = grams.counts()
        c, n, i = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32)), pa.array((n * BINS + i).astype(np.int32)), pa.array(total[c, n, i])], names=["class", "bin", "n"])

    return run


def fit(docs: DataFrame, key: str, text: str) -> Model:
    """The models of prose, filler, notices and fields: from the seeds, and from what the documents say.

    Fitted on every document that has a key and a text.  A first pass counts the n-grams of all lines that the seeds do
    not take for residue as prose; two more count again with the models so far, prose as prose and as residue the lines
    that clearly are and the others of texts that mostly are.  What comes to the driver is at most three times ORDERS * BINS counts, whatever the number of documents.  Counts are scaled to fixed masses, so that the
    smoothing weighs the same at every size of corpus.
    """
    src = session.spread(docs.where(F.col(text).isNotNull() & F.col(key).isNotNull()).select(F.col(text).alias("text")))
    seeds = seed_counts()
    counts = seeds
    for step, sure in enumerate(SURE):
        shared = docs.sparkSession.sparkContext.broadcast(packed(counts))
        got = src.mapInArrow(_count(shared, sure, step > 0), "class int, bin int, n long").groupBy("class", "bin").agg(F.sum("n").alias("n")).toArrow()
        new = np.zeros((len(CLASSES), ORDERS * BINS))
        new[np.asarray(got.column("class").combine_chunks()), np.asarray(got.column("bin").combine_chunks())] = np.asarray(got.column("n").combine_chunks())
        counts = list(seeds)
        for k in range(len(CLASSES)):
            c = new[k].reshape(ORDERS, BINS)
            counts[k] = seeds[k] + c * min(1.0, (LEARNT if k else MASS) / max(c[0].sum(), 1.0))
    return Model(counts)


def residue(docs: DataFrame, key: str, text: str, *, coverage: float = COVERAGE, model: Model | None = None) -> DataFrame:
    """``key, kind, placeholders, natural, filler, notice, residue``: one row per document.

    ``residue`` is true if a placeholder stands unfilled where a value belongs (kind ``placeholder``), or if, headings,
    navigation and footers apart, filler (kind ``filler``) or error notices and demands to allow scripts (kind
    ``notice``) cover at least ``coverage`` of the letters.  Otherwise kind is null.

    Method: character 5-gram models of natural prose, filler, notices and template fields; each character goes to the
    class with the largest likelihood over the window around it, within its line; a document is excluded by the covered
    share.  Placeholders are localised by windows in which a field is likelier than prose and then checked exactly: the
    line must hold a marked field outside code, quotation marks and quoted lines.
    Short lines parted by bars and lines on cookies count only if they are notices.

    Defined results: null and blank texts are not residue; rows with a null key are left out; of several texts of one
    key each is judged and the key is residue if any is; an empty table gives no rows.  Texts are read whole.
    """
    src = session.spread(docs.select(F.col(key).alias("key"), F.col(text).alias("text")).where("key IS NOT NULL"))
    shared = docs.sparkSession.sparkContext.broadcast(packed((model or fit(docs, key, text)).counts))
    kind = docs.schema[key].dataType.simpleString()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(unpacked(shared.value))
        for b in batches:
            n, holes, content = m.judge(b.column("text").to_pylist())
            bad = n[:, 1] + n[:, 2]
            only = (content >= LEAST) & (bad > 0) & (bad >= coverage * n.sum(axis=1))
            what = ["placeholder" if h else ("filler" if f >= e else "notice") if o else None for h, o, f, e in zip(holes, only, n[:, 1], n[:, 2])]
            yield pa.RecordBatch.from_arrays(
                [b.column("key"), pa.array(holes), pa.array(n[:, 0]), pa.array(n[:, 1]), pa.array(n[:, 2]), pa.array(what, pa.string())],
                names=["key", "placeholders", "natural", "filler", "notice", "kind"],
            )

    out = src.mapInArrow(judge, f"key {kind}, placeholders long, natural long, filler long, notice long, kind string")
    row = out.groupBy("key").agg(*(F.max(c).alias(c) for c in ("kind", "placeholders", "natural", "filler", "notice")))
    return row.select(F.col("key").alias(key), "kind", "placeholders", "natural", "filler", "notice", F.col("kind").isNotNull().alias("residue"))


def without_residue(docs: DataFrame, key: str, text: str, **more) -> DataFrame:
    """docs without those that are residue."""
    bad = residue(docs, key, text, **more).where("residue").select(F.col(key).alias("_residue_key"))
    return docs.join(bad, docs[key] == bad["_residue_key"], "left_anti")
