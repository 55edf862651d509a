"""Patterns and words of the checking SQL, written out for themselves.

They say the same as the engine's, but aren't taken from it: a slip in one of
the two shows in the comparison.
"""

# Patterns.
IMAGE_ONLY = r"^\s*!\[[^\]]*\]\([^)]+\)\s*$"
CAPTION = r"^\s*(?:[Ff][Ii][Gg][Uu][Rr][Ee]|[Ff][Ii][Gg]\.?|[Tt][Aa][Bb][Ll][Ee]\.?|图|表)\s*[0-9]+"
CAPTION_ANCHOR = CAPTION + r"\s*[:：.]"
STRUCTURAL = r"^(?:#{1,6}\s|[|]|!\[|[-*+]\s|[0-9]+[.)]\s|>|(?i:figure|fig\.?|tab\.?|table|图|表)\s*[0-9]+\s*[:：.])"
PAGE_NUMBER = r"^(?:[0-9]{1,4}|[IVXLCDMivxlcdm]{1,8}|(?i:page)\s*[0-9]+(?:\s*(?:(?i:of)|/)\s*[0-9]+)?|[0-9]{1,4}:[0-9]{1,3})$"
RUNNING_AUTHOR = r"^[A-Z][A-Za-z'-]{1,20}\s+et\s+al\.?$"
PUBLISHER_FOOTER = "|".join([
    r"(?i)published\s+as\s+a\s+conference\s+paper",
    r"arxiv[\s:]*[0-9]{4}\.[0-9]{4,5}",
    r"proceedings\s+of\s+the\s+[0-9]{2,}",
    r"all\s+rights\s+reserved",
    r"©\s*[0-9]{4}",
    r"j\.\s*[a-z]{2,10},\s*vol\.\s*[0-9]+",
    r"publication\s+date\s*:",
])
IDENTIFIER = r"^[A-Za-z0-9_.·:/()%+≥≤±×—=|,-]+$"
RUN_IN = r"(?s)^(_[^*_\n]{2,120}?[.。:：;；]_|[*]{2}[^*_\n]{2,120}?[.。:：;；][*]{2})[ \t]*(\S.*)$"
BARE_MACRO = r"\\[A-Za-z]+(?:_(?:[{][A-Za-z0-9,+-]{1,12}[}]|[A-Za-z0-9+-]))?(?:\^(?:[{][A-Za-z0-9,+-]{1,12}[}]|[A-Za-z0-9+-]))?"
# Characters and words.
SCRIPT_CHARS = "⁰¹²³⁴⁵⁶⁷⁸⁹ⁱⁿ⁺⁻⁼⁽⁾₀₁₂₃₄₅₆₇₈₉₊₋₌₍₎ₙ"
LOST_GLYPHS = "◆◊□◦�"
SENTENCE_EVIDENCE = (
    "we|our|ours|us|i|me|my|you|your|they|their|them|it|its|he|she|his|her|is|are|was|were|be|been|being|am|has|have|had|do|does|did|will|would"
    "|shall|should|can|could|may|might|must|that|this|these|those|which|who|whose|whom|there|here"
)
GENERIC_HEADINGS = (
    "abstract", "summary", "keywords", "introduction", "related work", "background", "motivation", "preliminaries", "preliminary", "methods",
    "methodology", "method", "approach", "experiments", "experimental setup", "results", "evaluation", "discussion", "conclusion", "conclusions",
    "future work", "references", "acknowledgments", "acknowledgements", "appendix", "contributions", "overview", "contents",
    "摘要", "关键词", "引言", "背景", "方法", "实验", "结果", "讨论", "结论", "参考文献", "附录", "目录",
)
