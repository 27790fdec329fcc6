"""How a value ends: the pushdown parser and the closing-word test that problems 3 and 4 share.

The parser reads fences, displayed maths, environments, markup, bold marks, brackets and quotations of a whole text with
one stack and says what is still open at its end; marks ``<|...|>`` have a stack of their own, and list items that are
announced by their sign only count as open too. The closing-word test looks at the last written line: full stops end it, closing statements of an
answer ("final answer: 12", "\\boxed{B}") and short direct answers are complete without one, and everything else that
runs up to the end was cut. A lost mark alone is no cut.
"""

from __future__ import annotations

import re

from tracemill.llm.common import CJK, FUNCTION_WORDS, WORD

ANY_MARK = re.compile(r"<\|([^|]*)\|>")
#: A mark that the end of the text cuts.
HALF_MARK = re.compile(r"<(?:\|[^|<>]*\|?)?$")
#: What shorteners write behind a cut; a full-stop sentence before it stays complete.
AFTER_CUT = re.compile(r"\s*(?:\.\.\.+|…+|\[(?:\.\.\.|…|cut|truncated|snip)\]|\((?:\.\.\.|…|cut|truncated|snip)\))\s*$", re.I)
#: Dots set off by a blank that also stand inside the line, or behind another sign, separate sentences there.
_ORNAMENT = re.compile(r"\s\.\.\.\s.*\s\.\.\.\s*$|[-*\s]\s\.\.\.\s*$", re.S)
#: Signs that may stand behind a full stop.
_BEHIND = "\"'”’»)]」』*_`"


def finished(text: str) -> bool:
    """Whether a text ends in a full stop or its like, whatever closes behind it."""
    return text.rstrip(_BEHIND)[-1:] in tuple(".!?。！？")


def after_cut(text: str) -> re.Match | None:
    """What a shortener wrote at the end."""
    return AFTER_CUT.search(text) if text.endswith("...") or text[-1:] in "…])" else None


#: Words that open the closing statement of an answer.
CLOSING = re.compile(
    r"(?:\b(?:final )?answer\b|\bresult\b|^(?:therefore|hence|thus|donc|also|daher|por tanto|por lo tanto),|\bsolution\b|\bconclusion\b|\br[ée]ponse\b|\br[ée]sultat\b|\brespuesta\b|\bresultado\b|\bantwort\b|\bergebnis\b|答案|结果|\\boxed)", re.I
)
#: A closing statement has its value: at most this many words behind the opening one.
VALUE_WORDS = 6
_LINKS = {w for x in FUNCTION_WORDS.values() for w in x}
_SHORT_ANSWER_WORDS = 4
_HEAD = re.compile(r"^\s*(?:[-*•]|\d+[.)]|#+)\s+")
#: Closing signs with what they close.
_PAIRS = {")": "(", "]": "[", "}": "{", "」": "「", "』": "『", "）": "（", "】": "【", "”": "“", "»": "«"}
_OPEN = set(_PAIRS.values())
#: What the parser reads: fences, maths, environments, markup, bold marks, brackets, quotations.
_TOKEN = re.compile(r"(?m)^[ \t]*(```+|~~~+)|(\$\$|\*\*)|\\(begin|end)\{(\w+\*?)\}|\\([()\[\]])|<(/?)(table|thead|tbody|tr|td|th|ul|ol|li|code|pre|b|i|em|strong|p|div|span|math|sub|sup)(?:\s[^<>]*)?>|([()\[\]{}「」『』（）【】“”«»])|(\")")
_VOID = {"li", "p", "td", "th", "tr", "thead", "tbody"}  # may be left open in markup
_ITEM = re.compile(r"(?m)^[ \t]*(?:(\d{1,3})[.)]|([-*•]))(?=\s|$)")


def open_marks(text: str) -> list[tuple[str, int]]:
    """(mark, place) of what a text leaves open at its end, outermost first: a pushdown parser over the whole text.

    Fences hide what is inside them. A closing sign closes what is innermost of its kind and drops what was opened inside
    and never closed; one that closes nothing is skipped, so list letters like ``a)`` do no harm. A round bracket may close
    a square one of the same line, as in half-open intervals. A straight quotation mark opens in front of a word and
    closes behind one; anything else (inches, seconds) is no quotation.
    """
    stack: list[tuple[str, int]] = []

    def close(mark: str) -> bool:
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] == mark:
                del stack[k:]
                return True
        return False

    for m in _TOKEN.finditer(text):
        fence, twice, env, name, maths, slash, tag, sign, quote = m.groups()
        if fence:
            if not close("```"):
                stack.append(("```", m.start()))
            continue
        if stack and stack[-1][0] == "```":
            continue
        if twice:
            if not close(twice):
                stack.append((twice, m.start()))
        elif env:
            if env == "begin":
                stack.append((f"\\begin{{{name}}}", m.start()))
            else:
                close(f"\\begin{{{name}}}")
        elif maths:
            if maths in "([":
                stack.append(("\\" + maths, m.start()))
            else:
                close("\\" + _PAIRS[maths])
        elif tag:
            tag = tag.lower()
            if slash:
                close(f"<{tag}>")
            elif tag not in _VOID:
                stack.append((f"<{tag}>", m.start()))
        elif sign:
            if sign in _OPEN:
                stack.append((sign, m.start()))
            elif not close(_PAIRS[sign]) and sign in ")]" and stack and stack[-1][0] in "[(" and "\n" not in text[stack[-1][1] : m.start()]:
                stack.pop()
        else:
            before, after = text[m.start() - 1 : m.start()], text[m.end() : m.end() + 1]
            if (not before or not before.isalnum()) and after and not after.isspace() and not any(x == '"' for x, _ in stack):
                stack.append(('"', m.start()))
            elif before and not before.isspace():
                close('"')
    return stack


def still_open(text: str) -> list[str]:
    return [x for x, _ in open_marks(text)]


_COUNTED = ("```", "~~~", "$$", "**", '"')
_SENTENCE_END = re.compile(r"[.!?。！？][\"'”’»)\]」』*_]*\s+(?=[A-ZÀ-ÞА-Я\u4e00-\u9fff])|[。！？](?=\s*\S)|\n\s*\n|\n(?=[ \t]*(?:[-*•]|\d{1,3}[.)])\s)")


def unclosed(text: str, closed: bool = False) -> str | None:
    """What an otherwise finished text leaves open in a way that only a cut explains.

    Fences, displayed formulas and environments have to be closed. A single bracket, quotation, bold mark or tag counts
    where the sentence that opens it runs up to the end, a bracket only if its line ends before it closes or the text
    within three words; a sign lost in an earlier sentence, or several of them, only shows careless writing, and so does
    any in a text that its own mark closes (``closed``).
    """
    paired = all(text.count(a) == text.count(b) for b, a in _PAIRS.items())
    if paired and "\\begin" not in text and not any(text.count(x) % 2 for x in _COUNTED) and not ("<" in text and "</" in text):
        return None
    stack = open_marks(text)
    for mark, _ in stack:
        if mark in ("```", "$$") or mark.startswith("\\"):
            return "open " + mark
    if len(stack) == 1 and not closed:
        mark, place = stack[0]
        tail = text[place + len(mark) :].rstrip()
        if mark in _OPEN and mark not in "“«" and "\n" not in tail and len(WORD.findall(tail)) > 3:
            return None
        if tail and not _SENTENCE_END.search(tail) and not CLOSING.search(tail):
            return "open " + mark
    return None


def bare_item(text: str) -> bool:
    """Whether a text ends in the sign of the next list item, with nothing behind it."""
    last = None
    for last in _ITEM.finditer(text):
        pass
    if last is None or text[last.end() :].strip():
        return False
    if last.group(2):
        return bool(re.search(r"(?m)^[ \t]*" + re.escape(last.group(2)) + r"\s+\S", text[: last.start()]))
    return bool(re.search(rf"(?m)^[ \t]*{int(last.group(1)) - 1}[.)]\s+\S", text[: last.start()]))


def _line_is_cut(line: str, only: bool) -> str | None:
    """Why the last line is cut, None for a complete one; ``only`` says that nothing stands before it."""
    shortened = after_cut(line.rstrip())
    if shortened:
        if _ORNAMENT.search(line):
            return None
        line = line[: shortened.start()]
        if not line or finished(line):
            return None
        return "shortened"
    if finished(line):
        return None
    words = WORD.findall(line.lower())
    # sentences of the line; the last one is unfinished or a closing statement
    last = re.split(r"(?<=[.!?。！？])[\"'”’)\]]*\s+|(?<=[。！？])", line)[-1]
    closing = list(CLOSING.finditer(last))
    if closing:
        behind = last[closing[-1].end() :]
        value = WORD.findall(behind)
        open_ = still_open(last)
        if open_:
            return "open " + open_[-1]
        # 'The answer is' and 'Final answer:' still lack their value
        filler = {"is", "est", "es", "ist", "lautet", "the", "la", "die", "le", "the"}
        if [w for w in value if w.lower() not in filler] or CJK.search(behind.replace("是", "")):
            return None if len(value) <= VALUE_WORDS else "sentence"
        if re.search(r"[^\s:：*.,是]", behind) and not value:
            return None  # a sign or formula is a value too
        return "no value"
    if only and len(words) <= _SHORT_ANSWER_WORDS and not CJK.search(line):
        # a short direct answer: a letter, number, name or few words; no beginning of a sentence
        first = words[0] if words else ""
        if not words:
            return None
        if still_open(line):
            return "open"
        if len(words) <= 2 and (first not in _LINKS or len(words) == 1) or first not in _LINKS and words[-1] not in _LINKS or words[0] in {"none", "no", "not", "non", "nicht", "keine", "ninguno", "aucun", "yes", "oui", "ja", "si", "sí"}:
            return None
    return "word" if re.search(r"\w$", line) else "sentence"


def cut_reason(text: str | None) -> str | None:
    """Why a value was cut, None where it is complete or blank."""
    if not text:
        return None
    body = text.rstrip()
    if not body:
        return None
    if body.endswith("�"):
        return "broken character"
    shortened = after_cut(body)
    core = body[: shortened.start()].rstrip() if shortened else body
    if not core:
        return None
    if "<" in core[-40:]:
        half = HALF_MARK.search(core)
        if half and (len(half.group()) > 1 or "<|" in core[: half.start()]):
            return "half a mark"
    if "<|" in core:
        return _tagged(core, shortened is not None)
    at = max(core.rfind("\n"), core.rfind("\r"))
    line = _HEAD.sub("", core[at + 1 :]) if at >= 0 or core[:1] in "-*#•" or core[:1].isdigit() and re.match(r"\d+[.)] \S+ \S", core) else core
    if len(core) - at < 12 and bare_item(core):
        return "list"
    if not line.strip():
        return None
    # the line keeps what was written behind the cut
    return _line_is_cut(line.strip() + (body[len(core) :] if shortened else ""), at < 0) or unclosed(core)


#: What each kind of end scores; every other reason for a cut scores nothing.
_SCORES = {"sentence": 0.2, "word": 0.1, "last step": 0.2, "no value": 0.1, "list": 0.1}


def terminality(text: str | None, reason: str | None) -> float | None:
    """How much the closing words of a value look like its end, from 0 to 1; below a half it was cut (``reason``). Null for blanks.

    A full stop scores most, a closing statement without one less, a short direct answer least; among cut values a
    function word at the end scores a quarter of any other.
    """
    if text is None or not text.strip():
        return None
    tail = text[-200:]
    tail = (ANY_MARK.sub(" ", tail) if "<|" in tail else tail).rstrip()
    if reason is None:
        if finished(tail):
            return 1.0
        return 0.9 if "<|answer_end|>" in text[-40:] or CLOSING.search(tail.rsplit("\n", 1)[-1][-100:]) else 0.7
    words = WORD.findall(tail.lower())
    score = _SCORES.get(reason, 0.4 if reason.startswith("open") and finished(tail) else 0.0)
    return score / 4 if words and words[-1] in _LINKS else score


def _tagged(core: str, shortened: bool) -> str | None:
    """A value with marks: complete where its answer is closed (or holds something) and its last step reads to its end."""
    if core.endswith("<|answer_end|>") and (at := core.rfind("<|answer_start|>")) > 0:
        # the common case: a closed answer, so only the end of what stands before it counts
        near = core[max(0, at - 600) : at]
        marks = list(ANY_MARK.finditer(near))
        if marks and any(near[a.end() : b.start()].strip() for a, b in zip(marks, marks[1:])):
            return _last_step(near, marks, len(marks))
    marks = list(ANY_MARK.finditer(core))
    if not marks:
        return "half a mark"
    names = [m.group(1).strip() for m in marks]
    last, tail = names[-1], core[marks[-1].end() :].strip()
    stack: list[str] = []
    for name in names:
        if name.endswith("_start"):
            stack.append(name[:-6])
        elif name.endswith("_end") and name[:-4] in stack:
            while stack.pop() != name[:-4]:
                pass
    if not any(ANY_MARK.sub("", core).split()) and not stack:
        return None  # an empty skeleton
    if shortened and last != "answer_end":
        return "shortened"
    if "answer_start" in names or "answer_end" in names:
        if last == "answer_start" and not tail:
            return "no value"
        return _last_step(core, marks, names.index("answer_start" if "answer_start" in names else "answer_end"))
    if not tail:
        # closed reasoning without an answer is judged by its last step
        return "open " + stack[-1] if stack else _last_step(core, marks, len(marks))
    if last == "reasoning_end" or not stack:
        return _line_is_cut(tail.splitlines()[-1].strip(), False)
    return "open " + last if last.endswith("_start") else "between marks"


def _last_step(core: str, marks: list[re.Match], before: int) -> str | None:
    """Why the last written step in front of mark number ``before`` is cut."""
    for k in range(before - 1, -1, -1):
        end = marks[k + 1].start() if k + 1 < len(marks) else len(core)
        inside = core[marks[k].end() : end].strip()
        if k == before - 1:
            inside = re.sub(r"(?:^|(?<=\s))[^\W\d]+\s*[:：]$", "", inside).strip()  # the word that announces the answer
        if inside:
            if marks[k].group(1).strip().endswith("name_start"):
                return None
            return "last step" if _line_is_cut(inside.splitlines()[-1].strip(), False) or unclosed(inside, closed=True) else None
    return None
