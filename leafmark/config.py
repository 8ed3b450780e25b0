"""Fixed values of the document-analytics operators: limits, word lists, patterns and weights."""

import re

# Limits and thresholds
READING_WORDS_PER_MINUTE = 235
CHUNK_WORDS, CHUNK_LEAST_WORDS = 190, 14
STRONG, POSSIBLE, WEAK, MARGIN = 58, 34, 18, 7
SNIPPET_CHARS, SNIPPET_LEAD = 180, 58
QUERY_CHARS, QUERY_TOKENS = 120, 16
BM25_K1, BM25_B, LENGTH_FLOOR, IDF_FLOOR = 1.2, 0.72, 0.25, 0.4
MAX_MESSAGES, HEAD_MESSAGES, MIDDLE_MESSAGES, TAIL_MESSAGES = 220, 24, 26, 170

# Regular expressions that both Java and RE2 read alike. White space as in ECMAScript; words are ASCII.
SPACES = r"[\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+"
ZERO_WIDTH = r"[\x{200B}-\x{200D}\x{FEFF}]"
WORD = r"[A-Za-z0-9_'-]*[A-Za-z0-9_][A-Za-z0-9_'-]*"
# The same for Java, whose matcher asks a class's parts one after the other: most characters are settled by the first question.
_SPACE_JAVA = rf"\x00- \x7F-\x{{FFFF}}&&{SPACES[:-1]}"
SPACES_JAVA = rf" [{_SPACE_JAVA}]+|[{_SPACE_JAVA}&&[^ ]][{_SPACE_JAVA}]*+"  # runs that aren't one space
ZERO_WIDTH_MARKS = "\u200b\u200c\u200d\ufeff"
# A text up to its ninth word; what is no word after cleaning may stand before the first.
NINE_WORDS_JAVA = rf"\A[{SPACES[1:-2]}\x{{200B}}-\x{{200D}}]*+(?:[^{SPACES[1:-2]}]++[{SPACES[1:-2]}]++){{0,8}}[^{SPACES[1:-2]}]*+"
WORD_JAVA = r"\w[\w'-]*+"  # as many as of WORD, from a word's first letter or digit on
WORD_RE2 = r"\w[\w'-]*"
TOKEN_JAVA = r"\p{Alpha}[\w./+#-]++|(?<!\w)\d+\p{Alpha}(?:[\p{Alnum}./+#-]*\p{Alnum})?(?!\w)"
TOKEN_RE2 = r"[A-Za-z][A-Za-z0-9_./+#-]+|\b[0-9]+[A-Za-z][A-Za-z0-9./+#-]*\b"
PLAIN_TOKEN = r"^[A-Za-z][a-z]*+[-_./+#]*+$"  # never technical
TECHNICAL = r"[A-Z]{2,}|[A-Za-z][A-Z][A-Za-z0-9]|[A-Za-z][-_./+#][A-Za-z0-9]|[A-Za-z][0-9]|[0-9][A-Za-z]"
EDGES = r"^[^A-Za-z0-9+#]+|[^A-Za-z0-9+#]+$"

# Words that never become terms.
STOP_WORDS = """
about above after again against also because before being below between both cannot could does doing down during each
from further have having here into just more most only other over same should some such than that their then there
these they this through under very what when where which while with would your page section article guide click home
menu navigation subscribe newsletter comment comments related
able across almost along already among another around back best better can change content current different enough
broad every first following found general give given good great guidance help helps important including inside keep
last later long make makes many might must near need needs often part parts point possible probably quite really right
several show shows simple small still strong take using value want way well will without work works you and the for
not are was were has had but
anyone context describe describes detail details example explains gives instructions notes orientation parameters
plain-language project quickly reader recap reviewing short skimming steps takeaway useful
abstract appendix author background bibliography chapter conclusion contents copyright discussion evidence figure
finding findings heading introduction links main method methods overview privacy references results sections sources
summary table terms tips title
""".split()

THEME_STOP_WORDS = STOP_WORDS[: STOP_WORDS.index("related") + 1]  # those that never become themes
THEME_TOKEN = r"[A-Za-z][A-Za-z0-9_./+#-]{2,}"
THEME_TECHNICAL = r"{B}(?:[A-Z]{2,}(?:-[A-Z0-9]{2,})*|[A-Za-z]+[A-Z][A-Za-z0-9]*|[A-Za-z]+[-_][A-Za-z0-9_-]+|[A-Za-z]+[0-9][A-Za-z0-9./-]*|[A-Za-z]+\.[A-Za-z0-9.]+){B}"
THEME_WEIGHTS = {"title": 4, "url": 2, "heading": 3, "technical": 3, "latest_question": 4}
MOST_THEMES, MOST_REPEATED, MOST_TECHNICAL, MOST_PHRASES, MOST_URL_TERMS, MOST_MATCHED = 18, 10, 12, 12, 16, 8
TITLE_WEIGHT, LABEL_WEIGHT, TOPIC_WEIGHT, FALLBACK_TOPICS, FALLBACK_WEIGHT = 2.5, 0.8, 2.4, 10, 1.4
SALIENCE_MOST, LOCAL_MOST = 14, 18

SYNONYMS = [
    ["cost", "price", "fee", "fees"],
    ["requirement", "requirements", "eligibility", "qualification", "qualifications"],
    ["setup", "installation", "install", "getting", "started", "start", "quickstart", "quick_start"],
    ["problem", "issue", "error", "troubleshooting", "trouble"],
    ["result", "results", "outcome", "outcomes", "finding", "findings"],
    ["step", "steps", "instruction", "instructions", "procedure", "procedures"],
    ["warning", "caution", "risk", "risks"],
]

# Words whose stem no rule gives; all others of these families are regular.
IRREGULAR_STEMS = {"applied": "apply", "applies": "apply", "applying": "apply", "apply": "apply", "issues": "issue", "issue": "issue", "findings": "finding", "finding": "finding", "warnings": "warning", "warning": "warning", "fees": "fee", "outcomes": "outcome", "procedures": "procedure", "procedure": "procedure"}

# Signals of a section: name, pattern (searched in the lower-case title and text), and its useful and importance weight.
SIGNALS = [
    ("summary", r"summary|recap|key takeaways?|tl;dr|tldr|bottom line|in short|executive summary|what matters", 0, 0),
    ("direct_action", r"use this|do this|copy(?: and paste)?|paste this|run this|replace(?: that| it)?|change(?: that| it)?|set this|configure|install|deploy|ship|update|remove|add|create|select this option", 34, 18),
    ("comparison", r"vs\.?|versus|compared with|compared to|comparison|pros and cons|trade-?offs?|difference between|better than", 0, 22),
    ("accepted_answer", r"accepted answer|top answer|top comment|marked as solution|solved|worked for me|this fixed it|confirmed fix", 46, 0),
    ("troubleshooting", r"error|bug|issue|problem|fix|fixed|workaround|troubleshoot|root cause|resolved|solution", 0, 0),
    ("main_argument", r"main argument|central argument|key argument|thesis|claim|we argue|this paper argues|the argument is|main point|central claim", 42, 32),
    ("key_evidence", r"key evidence|evidence|data show|results show|findings show|analysis shows|supports the claim|we found|we find|indicates?|demonstrates?|significant", 34, 26),
    ("methods", r"methods?|methodology|materials and methods|experimental setup|approach|procedure|data and methods", 22, 18),
    ("results", r"results?|findings?|evaluation|experiments?|observations?|analysis", 38, 28),
    ("conclusion", r"conclusion|summary|recap|bottom line|key takeaway|final answer|final thoughts|what to do next|in short", 34, 30),
    ("references", r"references|bibliography|works cited|literature cited|citations", -62, -50),
    ("appendix", r"appendix|appendices|supplementary|supplemental materials?", -36, 0),
    ("table_of_contents", r"table of contents|contents", -48, 0),
    ("boilerplate", r"copyright|all rights reserved|privacy policy|terms of service|cookie preferences|powered by|site map|sitemap|skip to content|back to top|downloaded from|licensed under|journal homepage|issn|doi:", -70, -44),
    ("definition", r"what is|definition|means|refers to|defined as|is a|are a|concept|overview", 28, 24),
    ("warning", r"warning|caution|important|avoid|risk|mistake|pitfall|note|before you|watch out|do not|limitation|gotcha|breaking change|security|deprecated", 0, 24),
    ("example", r"example|for example|case study|sample|snippet|code|demo|template|numbers?|data|benchmark|comparison|compare|versus|vs\.?|pros and cons|trade-?offs?", 24, 0),
    ("answer", r"answer|solution|solved|fix|explained|why it matters|what to do|the point|in practice|best option|short answer|the takeaway|here'?s why|start here|actual answer|final answer", 46, 0),
    ("recommendation", r"best|recommended|recommend|top pick|our pick|use this|prefer|should use|worth it|winner|ranked|must-have", 30, 0),
    ("finality", r"final|finally|complete|done|result|outcome|finished|end state|working version|production-ready|latest answer|corrected answer|final version|use this version", 30, 0),
    ("changelog", r"changelog|release notes?|version history|what'?s new|breaking changes?|deprecated", -58, -36),
]
FLUFF = [
    ("negative", r"advertisement|sponsored|sponsor|affiliate|subscribe|newsletter|sign up|cookie|privacy preferences|accept all|related posts?|recommended articles?|share this|follow us|comments?|leave a reply|table of contents|also read|read more|author bio|about the author|disclosure|partners?|promotion|limited offer|promo code|buy now|shop now|deal|giveaway|webinar|download our|join our|privacy policy|terms of service|copyright|all rights reserved|powered by|site map|sitemap|skip to content|back to top", 58),
    ("soft", r"in this article|in this post|before we dive in|let'?s dive in|when i first|i remember|back in|my journey|ever wondered|you'?re not alone|without further ado|it depends on your needs|as you may know|these days|nowadays|in today'?s world|ultimate guide|comprehensive guide|everything you need to know|we may earn|our editorial process|why you should trust us", 26),
    ("disclosure", r"disclosure|this post may contain affiliate|as an amazon associate|reader-supported|commission", 76),
]
FLUFF_OF_SIGNALS = {"references": 86, "table_of_contents": 70, "appendix": 48, "boilerplate": 92, "changelog": 46}

# Section types of paged documents, first match wins.
PAGED_TYPES = [
    ("toc", r"table of contents|contents"), ("boilerplate", r"copyright|all rights reserved|page [0-9]+ +of +[0-9]+|privacy policy|terms of service|downloaded from"), ("works_cited", r"references|bibliography|works cited|literature cited|citations"),
    ("appendix", r"appendix|appendices|supplementary|supplemental materials?"), ("signature", r"signature|signed|sincerely|respectfully submitted|authorized representative"),
    ("form", r"form|notice|application|claim number|case number|account number|date of birth|address|phone|email"), ("table", r"table|figure|chart|column|row|total|subtotal"), ("abstract", r"abstract"), ("results", r"results?|findings?|evaluation|experiments?|observations?|analysis"),
    ("discussion", r"discussion"), ("conclusion", r"conclusions?|summary|final remarks|closing remarks"), ("methods", r"methods?|methodology|materials and methods|experimental setup|approach|procedure|data and methods"), ("introduction", r"introduction|background|overview"),
]

# Flags of a conversation turn.
TURN_FLAGS = [
    ("has_final_answer", r"final answer|final version|bottom line|in short|short answer|use this|here'?s the answer|the answer is"),
    ("has_revision", r"updated|correction|corrected|revised|instead|actually|replace that|use this version|latest"),
    ("has_summary", r"summary|recap|tl;dr|tldr|key takeaways?|bottom line|in short|what matters"),
    ("has_recommendation", r"recommend|recommended|best option|best choice|go with|choose|use this|my recommendation"),
    ("has_key_explanation", r"here'?s why|why this works|the reason|because|key point|what matters|explanation"),
    ("has_hedged_draft", r"one possible|might|may not|rough|draft|first attempt|initial answer|not sure|probably"),
    ("has_failed_answer", r"something went wrong|network error|failed to generate|try again|regenerate response|error occurred|generating response|loading response|still loading"),
]
CORRECTION = r"actually|correction|correct|wrong|not what i meant|instead|fix that|revise|update|change|use this|make it"
STRONG_MIDDLE = r"final answer|final version|correction|corrected|revised|summary|tl;dr|tldr|bottom line|use this|working version|copy(?: and paste)?|complete code"
SHORT_CONFIRMATION = r"^(yes|no|ok|okay|sure|done|got it|sounds good|correct|thanks|you'?re welcome)[.! ]*$"
CODE_BLOCK = r"```"


_LEFT, _RIGHT = r"(?<!\w)", r"(?!\w)"
_EITHER = "(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"


def _alternatives(pattern: str) -> list[str]:
    """The pattern's alternatives outside of brackets."""
    out, depth = [""], 0
    for c in pattern:
        depth += (c == "(") - (c == ")")
        if c == "|" and depth == 0:
            out.append("")
        else:
            out[-1] += c
    return out


def bounded(pattern: str) -> str:
    """The pattern between ASCII word bounds, for Java, whose own bounds are Unicode's. Alternatives that begin and end
    with word characters need one look at either side; others may begin or end a word on any side."""
    plain = [a for a in _alternatives(pattern) if re.fullmatch(r"[a-z0-9].*(?:[a-z0-9][?]?|[a-z0-9]\)[?]?|[a-z0-9]\)?)", a)]
    others = [a for a in _alternatives(pattern) if a not in plain]
    parts = ([f"{_LEFT}(?:{'|'.join(plain)}){_RIGHT}"] if plain else []) + ([f"{_EITHER}(?:{'|'.join(others)}){_EITHER}"] if others else [])
    return "|".join(parts)


def java_bounds(pattern: str) -> str:
    """The pattern with {B} as an ASCII word bound of Java."""
    return pattern.replace("{B}", _EITHER)
