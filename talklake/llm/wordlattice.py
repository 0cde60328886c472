"""Word lattices for scripts without blanks: Chinese, Japanese and Thai stretches as words with classes.

Every position of a stretch is a node. An edge is a dictionary word, or an unknown word of the script: a Han sign or two, a run of
katakana, one hiragana sign, a Thai letter cluster, a run of anything else. Edges cost less the better the word is known, and two neighbours cost
what their classes say; the cheapest path is the reading. A gap between two words of it ends a sentence if a final
particle or a polite ending stands before it and an opening word after it.
"""

from __future__ import annotations

import re
from functools import lru_cache

#: Classes: content, joining particle, predicate, polite predicate (may end), final particle, opening word, quotative, other known word.
CONTENT, JOIN, PREDICATE, POLITE, FINAL, OPENING, QUOTATIVE, OTHER, START = "NJVEFOQXS"

# Japanese function words and words that open sentences, by class.
JAPANESE = {
    JOIN: "は が を に へ で の も から まで より や など だけ しか ほど くらい ながら ので のに けど けれど ば たら なら て って には では とも",
    PREDICATE: "だ だった だろう た ない なかった たい る らしい ようだ そうだ である",
    POLITE: "です でした でしょう ます ました ません ませんでした ましょう ください",
    FINAL: "か ね よ よね な ぞ ぜ わ さ かな かしら っけ",
    OPENING: "しかし でも だから それで そして また さて ところで ところが つまり たとえば なぜなら すると じゃあ それから けれども ただし なお 今日 明日 昨日 今 私 僕 彼 彼女 "
    "それ これ あれ ここ そこ この その あの もう まず 次に 最近 とても とうとう とりあえず とにかく とくに とっさに なぜ どうして",
    QUOTATIVE: "と という といって とか とは とも といい と言 とのこと",
    OTHER: "とき ときどき とたん となり とおり とある とんでもない とっても いつか どこか だれか なにか 誰か 何か こと もの よう ところ ほか ため はず わけ わたし あなた なか よく さん",
}
# The same for Chinese. The last class holds words that contain a particle's sign and are not that particle.
CHINESE = {
    JOIN: "的 地 得 着 过 了 在 把 被 和 跟 与 对 从 向 给 也 都 就 还 却 很",
    FINAL: "吗 呢 吧 啊 呀 啦 嘛 哦 喔 呗 咯",
    OPENING: "但是 可是 所以 因为 然后 后来 不过 而且 于是 因此 另外 其实 今天 明天 昨天 我 你 他 她 我们 你们 他们 她们 这 那 这个 那个 现在 如果 虽然 接着 最后 首先 大家 为什么 怎么 同时 例如",
    OTHER: "酒吧 网吧 吧台 吧女 茶吧 吗啡 干吗 呢子 毛呢 花呢 呢喃 啊呀 啊哈 啦啦队 为了 除了 了解 极了 我国 他人 他乡 其他 其她 吉他 这样 那样 那么 这么",
}
# The same for Thai.
THAI = {
    JOIN: "ที่ ซึ่ง และ หรือ กับ ของ ใน ว่า จึง ก็ แล้ว ไป มา ได้ ให้ เมื่อ ครั้ง",
    FINAL: "ครับ ค่ะ คะ จ้ะ จ้า ฮะ นะ นะครับ นะคะ นะค่ะ ครับผม",
    OPENING: "แต่ เพราะ ดังนั้น เพราะฉะนั้น จากนั้น ต่อมา อย่างไรก็ตาม นอกจากนี้ วันนี้ พรุ่งนี้ เมื่อวาน ทำไม ผม ฉัน ดิฉัน เขา เธอ เรา หลังจากนั้น ตอนนี้ ส่วน",
    OTHER: "คะแนน คะนอง ชนะ ขณะ คณะ นะโม ศิลปะ ผมเปีย ส่วนตัว ส่วนใหญ่ สัมภาษณ์ แต่ง แต่งงาน เขาใหญ่ ภูเขา",
}

_WORD_COST = 20  # of a known word, less what its length earns
_JOIN_COST = {  # of neighbours; others cost nothing
    (START, FINAL): 30, (JOIN, FINAL): 15, (CONTENT, FINAL): 6, (OPENING, FINAL): 12, (START, QUOTATIVE): -6, (PREDICATE, FINAL): -4, (POLITE, FINAL): -6,
    (FINAL, FINAL): 4, (CONTENT, POLITE): -2, (FINAL, OPENING): -4, (POLITE, OPENING): -2, (START, JOIN): 6, (OPENING, QUOTATIVE): 4,
}
_CLUSTER = re.compile("[เ-ไ]?[ก-ฮ][ะ-ฺ็-๎]*|[฀-๿]")
_KATAKANA = re.compile("[ァ-ヿㇰ-ㇿｦ-ﾟ]+")
_HIRAGANA = re.compile("[ぁ-ゟ]")
_HAN = re.compile("[㐀-鿿豈-﫿\U00020000-\U000323af々〆]")
_REST = re.compile("[^฀-๿ぁ-ヿㇰ-ㇿｦ-ﾟ㐀-鿿豈-﫿\U00020000-\U000323af々〆]+")


class Lattice:
    """A dictionary ready for reading: ``words`` maps a word to its classes."""

    def __init__(self, *languages: dict[str, str]) -> None:
        self.words: dict[str, str] = {}
        for language in languages:
            for kind, listed in language.items():
                for word in listed.split():
                    if kind not in self.words.get(word, ""):
                        self.words[word] = self.words.get(word, "") + kind
        self._longest: dict[str, int] = {}
        for word in self.words:
            self._longest[word[0]] = max(len(word), self._longest.get(word[0], 0))
        ends = [w for w, kinds in self.words.items() if FINAL in kinds or POLITE in kinds]
        opens = [w for w, kinds in self.words.items() if OPENING in kinds]
        listed = lambda ws: "|".join(sorted(map(re.escape, ws), key=len, reverse=True))
        #: Where a gap that ends a sentence can be at all: an ending's signs before an opening word's.
        self._possible = re.compile(f"(?:{listed(ends)})(?={listed(opens)})") if ends and opens else None
        self.read = lru_cache(1 << 12)(self._read)

    def _edges(self, text: str, at: int) -> list[tuple[int, str, int]]:
        """(end, class, cost) of the words that may begin at ``at``."""
        out = []
        for n in range(1, self._longest.get(text[at], 0) + 1):
            for kind in self.words.get(text[at : at + n], "") if at + n <= len(text) else "":
                out.append((at + n, kind, _WORD_COST - 4 * min(n, 4) + (2 if kind == OTHER else 0)))
        if m := _CLUSTER.match(text, at):
            out.append((m.end(), CONTENT, 22))
        elif m := _KATAKANA.match(text, at):
            out.append((m.end(), CONTENT, 20))
        elif _HIRAGANA.match(text, at):
            out.append((at + 1, CONTENT, 26))
        elif _HAN.match(text, at):
            out.append((at + 1, CONTENT, 22))
            if at + 1 < len(text) and _HAN.match(text, at + 1):
                known = (text[at] in self.words) + (text[at + 1] in self.words)  # an unknown word seldom holds a known one
                out.append((at + 2, CONTENT, 30 + 12 * known))
        else:
            out.append((_REST.match(text, at).end(), CONTENT, 20))
        return out

    def _read(self, stretch: str) -> tuple[tuple[int, int, str], ...]:
        """(start, end, class) of the words on the cheapest path; of equally cheap ones that with the longest words from the end."""
        best: list[dict[str, tuple[int, int, str]]] = [{} for _ in range(len(stretch) + 1)]
        best[0][START] = (0, -1, "")
        for at in range(len(stretch)):
            here = best[at]
            if not here:
                continue
            for end, kind, cost in self._edges(stretch, at):
                total, before = min((c + _JOIN_COST.get((k, kind), 0), k) for k, (c, _, _) in here.items())
                if kind not in best[end] or total + cost < best[end][kind][0]:
                    best[end][kind] = (total + cost, at, before)
        if not stretch:
            return ()
        kind = min(best[-1], key=lambda k: (best[-1][k][0], k))
        out, end = [], len(stretch)
        while end:
            _, at, before = best[end][kind]
            out.append((at, end, kind))
            end, kind = at, before
        return tuple(reversed(out))

    def opens_with_quotative(self, stretch: str) -> bool:
        """Whether the first word after a quotation carries it on."""
        words = self.read(stretch)
        return bool(words) and words[0][2] == QUOTATIVE

    def may_end(self, text: str) -> bool:
        """Whether an ending's signs stand before an opening word's anywhere; elsewhere no gap can end a sentence."""
        return self._possible is not None and self._possible.search(text) is not None

    def ends(self, stretch: str) -> list[int]:
        """Gaps of a stretch without signs at which a sentence ends."""
        if not self.may_end(stretch):
            return []
        words = self.read(stretch)
        out = []
        for n in range(1, len(words)):
            kind = words[n - 1][2]
            before = words[n - 2][2] if n > 1 else START
            kana = _HIRAGANA.match(stretch, words[n - 1][0]) is not None
            closed = kind == POLITE or kind == FINAL and (before in (PREDICATE, POLITE, FINAL) if kana else before not in (START, JOIN, OPENING))
            if closed and words[n][2] == OPENING and n + 1 < len(words):
                out.append(words[n][0])
        return out


@lru_cache(1)
def lattice() -> Lattice:
    """The process's dictionary of all three languages."""
    return Lattice(JAPANESE, CHINESE, THAI)
