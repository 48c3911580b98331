"""Patterns and word lists, each written once for both regex dialects that read them.

``java`` is what Spark runs; ``re2`` is what the SQL twins run.  They accept the same text.
"""

from __future__ import annotations

from dataclasses import dataclass

#: White space as the note format defines it, for a character class.
SPACE = r"\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
WS = f"[{SPACE}]"


@dataclass(frozen=True)
class Rewrite:
    """Replace every match of a pattern; ``keep`` is the group that stays (0: none, with ``by`` in its place).

    Every text with a match has one of ``needs`` in it, if there are any: a cheap test that saves the search.
    """

    pattern: str
    by: str = " "
    keep: int = 0
    java_pattern: str | None = None
    needs: tuple[str, ...] = ()

    @property
    def java(self) -> tuple[str, str]:
        pattern = (self.java_pattern or self.pattern).replace("(?m)", "(?md)")
        return pattern, f"${self.keep}" if self.keep else self.by

    @property
    def re2(self) -> tuple[str, str]:
        return self.pattern, f"\\{self.keep}" if self.keep else self.by


#: The rewrites that turn Markdown into prose, in order.
CLEANING = (
    Rewrite(r"\r\n", by="\n", needs=("\r\n",)),
    Rewrite(r"\A---[ \t]*\n(?s:.*?\n)??---[ \t]*(?:\n|\z)", by="", needs=("---",)),
    Rewrite(r"(?m)^```[^\n]*\n(?s:.*?)^```[^\n]*$", needs=("```",)),
    Rewrite(r"(?m)^~~~[^\n]*\n(?s:.*?)^~~~[^\n]*$", needs=("~~~",)),
    Rewrite(r"<!--(?s:.*?)-->", needs=("<!--",)),
    Rewrite(r"%%(?s:.*?)%%", needs=("%%",)),
    Rewrite(rf"(?m)^{WS}*[\p{{L}}\w-]+::[^\n]*$", needs=("::",)),
    Rewrite(r"!\[\[[^\]]*\]\]", needs=("![[",)),
    Rewrite(r"!\[[^\]]*\]\([^)]*\)", needs=("![",)),
    Rewrite(r"\[([^\]]*)\]\((?:[^()]|\([^)]*\))*\)", keep=1, java_pattern=r"\[([^\]]*)\]\((?:[^()]++|\([^)]*\))*+\)", needs=("](",)),
    Rewrite(r"\[\[[^\]|#]*(?:#[^\]|]*)?\|([^\]]+)\]\]", keep=1, needs=("[[",)),
    Rewrite(r"\[\[([^\]|#]*)(?:#[^\]|]*)?(?:\|[^\]]*)?\]\]", keep=1, needs=("[[",)),
    Rewrite(rf"\bhttps?://[^{SPACE}]+", needs=("http",)),
    Rewrite(r"`[^`\n]*`", needs=("`",)),
    Rewrite(r"</?[a-zA-Z][^>]*>", needs=("<",)),
    Rewrite(rf"(?m)^>{WS}*\[![^\]]*\][+-]?{WS}*", by="", needs=("[!",)),
    Rewrite(rf"(?m)^{WS}*(?:-{{3,}}|_{{3,}}|\*{{3,}}|={{3,}}){WS}*$", by="", needs=("---", "___", "***", "===")),
    Rewrite(rf"(?m)^{WS}*\|?{WS}*:?-{{2,}}[^\n]*$", by="", needs=("--",)),
    Rewrite(rf"(?m)^#{{1,6}}{WS}+([^\n]*)$", keep=1, needs=("#",)),
    Rewrite(rf"(\A|{WS})#[\p{{L}}\w/-]+", keep=1, needs=("#",)),
    Rewrite(r"[|*_>#=~]+", needs=tuple("|*_>#=~")),
    # In the first engine a single blank, which stays as it is, is no match.
    Rewrite(r"[\t\x{A0}\x{2000}-\x{200B}\x{202F}\x{3000} ]+", java_pattern=r"[\t\x{A0}\x{2000}-\x{200B}\x{202F}\x{3000}][\t\x{A0}\x{2000}-\x{200B}\x{202F}\x{3000} ]*| [\t\x{A0}\x{2000}-\x{200B}\x{202F}\x{3000} ]+"),
)
#: HTML to text: the tag and white-space rewrites alone.
HTML = (CLEANING[4], CLEANING[14], CLEANING[21])
#: The same characters, for trimming.
SPACES_ALONE = "".join(map(chr, [*range(0x09, 0x0E), 0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]))
TRIM = Rewrite(rf"\A{WS}+|{WS}+\z", by="")
DIGITS = Rewrite("[0-9]+", by="#")
SPACES = Rewrite(f"{WS}+", by=" ")
NO_SPACE = Rewrite(f"{WS}+", by="")
TAG_SEPARATORS = Rewrite("[/_-]+", by=" ")
#: What a file name may not hold and may not end with.
FILE_ILLEGAL = Rewrite(r'[\\/:*?"<>|#^\[\]]', by=" ")
FILE_TAIL = Rewrite("[. ]+$", by="")

#: The token and name patterns.
WORD = r"(\p{L}[\p{L}0-9-]{2,})"
ACRONYM = r"(\p{Lu}[\p{Lu}0-9-]{1,})"
TITLE_BREAK = r"[^\p{L}0-9-]+"

#: Words that are no keywords, Russian then English.  Matching happens after ё became е.
STOP_WORDS = frozenset(
    (
        "это этот эта эти того тому также такой такие такая когда чтобы потому если тоже только можно нужно надо очень более менее после перед через между которые который которая которое которых было быть будет будут есть себя свой свои своих своей всех всего весь вся может могут ваш наш мной меня тебя него неё нему ними чего чему кого кому сейчас здесь потом даже теперь просто всегда никогда где куда откуда почему зачем один одна одно два три для или как что так все уже еще ещё при без над под про его ее её они она оно мы вы ты них нас вас вам нам кто чем там тут вот этом этой этих тем том той всё весь сам сама сами самый либо ли бы же ни не да нет раз два также однако поэтому почти лишь иметь имеет является являются например вообще своё свою свое моя мой мои мою мне "
        "that this with from have will what when your they them their there then than into about which would could should these those also just like more most some such only other being been were where while after before because does make many much very each over the and for are but not you all any can had her was one our out has him his how its may new now old see two way who did get got let put say she too use via per yet"
    ).replace("ё", "е").split()
)

#: Names that say nothing about a group.
GENERIC_NAMES = frozenset("notes note things thing general misc miscellaneous other others ideas idea stuff inbox untitled index scan book video draft заметки заметка разное прочее другое общее идеи идея мысли входящие черновики черновик без названия".split()) | {"без названия"}
