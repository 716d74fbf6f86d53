"""Fixed values of the legal-text domain, as plain tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Documents, their names, kinds and aliases.
ROUTES = [
    ("ppc_1860", "PPC", "Pakistan Penal Code, 1860", "section", ["ppc", "pakistan penal code", "penal code"]),
    ("constitution_1973", "Constitution", "Constitution of the Islamic Republic of Pakistan, 1973", "article", ["constitution", "constitution of pakistan", "pakistan constitution", "constitutional"]),
    ("ata_1997", "ATA", "Anti-Terrorism Act, 1997", "section", ["ata", "anti terrorism act", "anti-terrorism act", "terrorism act"]),
    ("amla_2010", "AMLA", "Anti-Money Laundering Act, 2010", "section", ["amla", "anti money laundering act", "anti-money laundering act", "money laundering act"]),
]
FILE_ALIASES = [
    ("ppc_1860", ["pakistan penal code", "ppc"]),
    ("constitution_1973", ["constitution of pakistan", "constitution of pakistan 1973", "constitution"]),
    ("ata_1997", ["anti terrorism act", "anti-terrorism act", "terrorism act"]),
    ("amla_2010", ["anti money laundering act", "anti-money laundering act", "money laundering act"]),
]

# Words that carry no meaning in questions.
STOP_WORDS = "a an and are as at be by for from has he her his in is it of on or person that the their this to under was were which who with".split()

# Weights of phrases that mark a factual scenario.
SCENARIO_MARKERS = {
    "entrusted": 3, "embezzled": 3, "misappropriated": 3, "dishonestly taking": 3, "dishonestly took": 3, "dishonestly take": 3,
    "dishonestly moving": 3, "without the owner's consent": 3, "without owner's consent": 3, "without consent": 3, "took property": 3,
    "taking property": 3, "moving property": 3, "moved property": 3, "accountant": 2, "employee": 2, "clerk": 2, "servant": 2, "agent": 2,
    "murder": 3, "killed": 3, "caused death": 3, "riot": 2, "mob": 2, "stampede": 2, "death": 2, "injury": 2, "fraud": 2, "forged": 2,
    "kidnapped": 3, "used for personal": 3, "personal expenses": 3, "company funds": 3, "which provision applies": 2,
    "which provisions apply": 2, "which sections apply": 2, "under the law": 1, "charged": 2, "accused": 2, "defendant": 2, "found": 2,
    "lost wallet": 3, "found on the road": 3, "later decided to keep": 3, "kept it for personal use": 3,
}

# Concepts with markers, queries, preferred documents, preferred sections, keywords.
CONCEPTS = [
    ("murder", ["murder", "qatl-e-amd", "intentional killing", "killed a person", "commit a murder", "committed murder"],
     ["Section 300 definition of qatl-e-amd", "Section 302 punishment of qatl-e-amd"], [], ["300", "302"],
     ["murder", "qatl", "death", "intention", "knowledge", "punishment"]),
    ("theft", ["theft", "stole", "stolen", "stealing", "dishonestly taking", "dishonestly took", "dishonestly take", "dishonestly moving", "moves property", "moved property", "without the owner's consent", "without owner's consent", "without consent", "took property", "took the property", "taking property", "moving property"],
     ["Section 378 definition of theft", "Section 379 punishment for theft"], ["ppc_1860"], ["378", "379"],
     ["theft", "dishonestly", "movable", "property", "punishment"]),
    ("terrorism", ["terrorism", "act of terrorism", "acts of terrorism"],
     ["Section 6 definition of terrorism under the Anti-Terrorism Act", "Acts constituting terrorism under Section 6 of the Anti-Terrorism Act"], ["ata_1997"], ["6"],
     ["terrorism", "act of terrorism", "acts of terrorism", "section 6", "anti-terrorism act"]),
    ("breach_of_trust", ["embezzle", "embezzled", "entrusted", "company funds", "accountant", "employee funds", "personal expenses", "misappropriated funds", "breach of trust"],
     ["Section 405 criminal breach of trust", "Section 408 criminal breach of trust by clerk or servant", "Section 409 criminal breach of trust by public servant banker merchant or agent"], [], ["405", "408", "409"],
     ["entrusted", "dominion", "dishonestly", "misappropriates", "converts", "clerk", "servant", "agent"]),
    ("falsification", ["false entry", "falsified", "altered records", "altered accounts", "destroyed accounts", "omitted entries", "books of account"],
     ["Section 477-A falsification of accounts"], [], ["477-A"],
     ["falsification", "accounts", "false", "entry", "defraud"]),
    ("unlawful_assembly", ["mob", "riot", "rioting", "unlawful assembly", "common object", "stampede"],
     ["Unlawful assembly and common object liability", "Rioting and use of force by unlawful assembly"], [], [],
     ["assembly", "riot", "rioting", "common", "object", "force", "violence"]),
    ("abetment", ["incite", "inciting", "instigate", "instigating", "encourage", "abet", "abetment"],
     ["Abetment by instigation or intentional aid", "Abetment of an offence by the public or by more than ten persons"], [], ["107"],
     ["abetment", "instigates", "conspiracy", "intentionally", "aids"]),
    ("found_property", ["found property", "found wallet", "lost wallet", "found on the road", "lost property", "later decided to keep", "kept it for personal use", "finder"],
     ["Section 403 dishonest misappropriation of found property", "Section 378 theft property not in another person's possession"], [], ["403", "378"],
     ["found", "lost", "owner", "misappropriation", "possession", "dishonestly"]),
]

# Sections that need one of these words in the question.
REQUIREMENTS = {
    "317": ["heir", "inheritance", "succession", "beneficiary", "will", "estate"],
    "396": ["dacoity", "robbery", "five or more", "five persons", "gang"],
    "404": ["deceased", "death of owner", "estate", "servant of deceased"],
    "477-A": ["false entry", "falsified", "altered", "omitted", "accounts", "accounting records", "books"],
    "390": ["force", "fear", "threat", "hurt", "restraint", "weapon", "robbery"],
    "405": ["entrusted", "entrustment", "dominion", "agent", "employee", "servant", "clerk"],
}

# Least retrieval depth and final depth of each question type.
RETRIEVAL_K = {"section_lookup": 6, "article_lookup": 6, "definition": 8, "punishment": 10, "constitutional_right": 10, "comparison": 16, "fact_scenario": 25, "general": 12}
FINAL_K = {"punishment": 3, "definition": 3, "section_lookup": 4, "article_lookup": 4, "fact_scenario": 8, "comparison": 8}
FINAL_K_ELSE = 5

# Joined words that scanning produces, and what they stand for.
OCR_REPAIRS = {
    "forevery": "for every", "afemale": "a female", "aJudge": "a Judge", "bean received": "been received", "wilt of a deceased": "will of a deceased",
    "Mere, if": "Here, if", "Codeand": "Code and", "dealtwith": "dealt with", "andthe": "and the", "whichservant": "which servant",
    "ortaking": "or taking", "written,or": "written, or", "ofcall": "of call", "threeyears": "three years", "thesubject": "the subject",
    "byany": "by any", "himselfas": "himself as", "formof": "form of", "shallalso": "shall also", "shallnot": "shall not", "shallbe": "shall be",
    "mayextend": "may extend", "of1986": "of 1986", "toextra": "to extra", "provisionof": "provision of", "andnot": "and not", "inthe": "in the",
    "ofthe": "of the", "tothe": "to the", "withthe": "with the", "foran": "for an", "inthecase": "in the case", "ofthecase": "of the case",
    "isliable": "is liable",
}

# Substitutions, in order; \1 stands for a group. Words that a line end splits;
# words that scanning joins; amendment marks within a line; spacing of marks.
SPLIT_WORDS = [(r"(?<=[A-Za-z])-\s*\n\s*(?=[a-z])", ""), (r"\b(\d+)-\s*\n\s*([A-Z])\.", r"\1-\2.")]
JOINED_WORDS = [
    (r"\b(a|an|the|of|to|for|in|on|by|or|and)([A-Z][a-z]{2,})\b", r"\1 \2"),
    (r"(?i)\b(and|or|the|of|to|for|with|in|on|by)(?=(?:the|a|an|any|every|his|her|their|this|that|which|whom|whose|person|property|law|code|court|section|offence|imprisonment|fine|government|case|accused|convict|servant|agent|public)\b)", r"\1 "),
    (r"(?<=[A-Za-z])(?=\d{2,4}\b)", " "),
]
CITATION_MARKS = [
    (r"\b\d+\[\s*(\(\d+\))", r"\1"), (r"(?<=\w)\d+\[(?=[A-Za-z(\"'])", " "), (r"\]\s*\d+(?=[;,.:\s]|$)", ""), (r"(?<!\w)\d+\[\](?!\w)", ""),
    (r"(?<!\w)\d+\[(?!\w)", ""), (r"(?<!\w)\[\d+\](?!\w)", ""), (r"(?<!\w)\](?=[;,.:\s]|$)", ""),
    (r"(?i)(?<=\w)\d+(?=\s+(?:but|provided|except|and)\b)", ""), (r"\s{2,}", " "),
]
SPACING = [(r"\s+([,.;:?!])", r"\1"), (r"([,.;:?!])(?=[A-Za-z])", r"\1 "), (r"\(\s+", "("), (r"\s+\)", ")"), (r"(?<=[A-Za-z])(?=\d{2,4}\b)", " "), (r"[ \t]{2,}", " "), (r"\n{3,}", "\n\n")]

# Forms of lines that structure a page, and words that begin a provision's body.
SECTION_LINE = r"^\s*(\d+(?:-[A-Za-z]+)?[A-Za-z]?)\.\s*(.*?)\s*$"
CHAPTER_LINE = r"^\s*CHAPTER\s+([IVXLCDM]+|\d+)\s*$"
ROMAN_LINE = r"^\s*([IVXLCDM]{1,8})\s*$"
PART_LINE = r"^\s*PART\s+([IVXLCDM]+|\d+)\s*$"
EXPLANATION_LINE = r"^\s*Explanation(?:\s+(\d+))?\s*[:.-]?\s*(.*)$"
ILLUSTRATION_LINE = r"^\s*Illustrations?\s*[:.-]?\s*$"
ENUMERATION_LINE = r"^\s*\((?:[a-zA-Z]|\d+|[ivxlcdm]+)\)\s*"
BODY_STARTER = r"(?:Whoever|Any person|Every person|Nothing|Where|When|If|A person|Provided|In this section|For the purposes of)\b"

# A line that opens a provision (label, number, title); titles that none has; a
# title with the beginning of the body in its line, and lines that begin a body.
PROVISION = r"^[ \t]*(?:\d+\[\s*)?(?:(section|article)\s+)?(\d+(?:\s*-\s*[A-Za-z]+|[A-Za-z]+)?)\s*(?:\.\s*(?:[-—–]\s*)?|[—–:-]\s*)([^\n]+)"
NO_TITLES = [r"[\[\]]", r"[\W_]+$", r"(?:of\s+\d{4}|schedule\b|article\b|section\b|inserted\b|substituted\b|omitted\b|amended\b|renumbered\b|repealed\b)", r"(?:subs\.?|footnote\b|note\b|page\b|header\b|footer\b)"]
INLINE_BODY = r"^(.*?)(?:\.\s*)?[-—–:]\s*(\(\d+\).*|(?:Whoever|Any person|Every person|Nothing|Where|When|If|A person|Provided|In this (?:section|article)|For the purposes of|This Act|The provisions|In this Chapter|In case of|Subject to|Notwithstanding|It shall|There shall|No person)\b.*)$"
BODY_START = r"(?:\(\d+\)|Whoever|Any person|Every person|Nothing|Where|When|If\b|A person|Provided|In this section|In this article|For the purposes of|This Act|The provisions|In this Chapter|In case of|Subject to|Notwithstanding|It shall|There shall|No person|A person who)"
# Lines of a title, and its characters, at most.
LONGEST_TITLE_LINE, LONGEST_TITLE = 160, 220

# Terms that a page's keywords are taken from, and how many at most.
LEGAL_TERMS = [
    "abetment", "agent", "breach of trust", "cheating", "criminal force", "dishonestly", "embezzlement", "entrusted", "fine", "fraud", "fraudulently", "homicide", "imprisonment",
    "intention", "mischief", "misappropriation", "movable property", "murder", "offence", "property", "punishment", "rioting", "servant", "theft", "unlawful assembly",
]
MOST_KEYWORDS = 15

# Whole lines that are headers, footers or marks of a page.
HEADER_PATTERNS = [r"\s*Pakistan\s+Penal\s+Code(?:\s*\([^)]*\))?\s*", r"\s*Pakistan\s+Penal\s+Code\s*\(Act\s+XLV\s+of\s+1860\)\s*"]
FOOTER_PATTERN = r"\s*(?:page\s*)?\d+\s*"
ARTIFACT_PATTERNS = [
    r"\d+\[\]\s*\d+(?:\s+\d+\[\]\s*\d+)*", r"\d+\[", r"\]\s*\d+", r"\[\s*", r"\]\s*", r"\d+\[\s*", r"\d+\[\]\s*", r"\d+\]\s*", r"\[\d+\]\s*",
    r"\d+\[\(\d+\)\s*", r"\d+\[\s*\(\d+\)\s*", r"\d+\s*\[\s*\]\s*", r"\*+\s*", r"_+\s*", r"\d+\s*\]\s*", r"\[\s*\d+\s*", r"\d+\s*\[\s*\d*\s*\]\s*",
]

# Line starts of amendment notes, of their continuation, and of legal content.
AMENDMENT_NOTE = r"^\s*\d+\s+(?:Inserted\b|Substituted\b|Omitted\b|Added\b|Amended\b|Repealed\b|Proviso\s+omitted\b|The\s+following\s+was\s+omitted\b|The\s+words?.*?(?:inserted|substituted|omitted)\b|Sections?\s+\d)"
AMENDMENT_CONTINUATION = r"^\s*(?:for\s*:\s*[\"']|for\s+the\s+words?\b|the\s+words?\b|the\s+following\b|with\s+effect\s+from\b|vide\b|see\b|read\s+as\b|by\s+Act\b|by\s+Ordinance\b|by\s+the\b|\([IVXLCDM]+\s+of\s+\d{4}\)|S\.\s*\d+\b|and\s+Schedule\b)"
CONTENT_START = r"^(?:\d+(?:-[A-Za-z]+)?[A-Za-z]?\.\s+|CHAPTER\b|PART\b|SECTION\b|Explanation(?:\s+\d+)?\b|Illustrations?\b|\((?:[a-zA-Z]|\d+|[ivxlcdm]+)\)\s+|Whoever\b|Nothing\b|Provided\b|Where\b|When\b|If\b|Any\s+person\b|Every\s+person\b|A\s+person\b)"
LEGAL_REFERENCE = r"\b(?:section|sections|sec\.?)\s+(\d+(?:-[A-Za-z]+)?[A-Za-z]?)\b"

# How citations name and number a provision.
PROVISION_NUMBER = r"\d+(?:(?:\s*-\s*[A-Za-z]+)|[A-Za-z]+)?(?:\s*\(\s*[A-Za-z0-9]+\s*\))*"
SECTION_PREFIX = r"(?:sections|section|secs\.?|sec\.?|s\.?)"
ARTICLE_PREFIX = r"(?:articles|article|art\.?)"



def routes(spark: SparkSession) -> DataFrame:
    rows = [(i, d, s, f, p, a) for i, (d, s, f, p, own) in enumerate(ROUTES) for a in own]
    return spark.createDataFrame(rows, "route INT, document_id STRING, short_name STRING, full_name STRING, provision_type STRING, alias STRING")


def concept_markers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, c[0], m) for i, c in enumerate(CONCEPTS) for m in c[1]], "concept_order INT, concept STRING, marker STRING")


def scenario_markers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(SCENARIO_MARKERS.items()), "marker STRING, weight INT")

# What an answer is told to do, by question type, and the frame around it.
TASKS = {
    "fact_scenario": "Answer the scenario using only the retrieved excerpts.\nState the strongest applicable provision first, then include any other materially relevant provisions if they change the legal result.\nDo not stop after the first relevant sentence when more relevant context exists.",
    "punishment": "Answer the punishment completely but stay focused on the retrieved provision.\nInclude the law name, Section or Article number, heading, imprisonment limits, fine, forfeiture, and any material condition or exception.\nCover all punishment options present in the excerpt and do not stop after the first relevant sentence when more relevant context exists.",
    "section_lookup": "Answer the lookup completely but stay focused on the retrieved provision.\nInclude the law name, Section or Article number, heading, all materially relevant clauses, explanations, exceptions, consequences, and any punishment where relevant.\nDo not stop after the first relevant sentence when more relevant context exists.",
    "article_lookup": "Answer the lookup completely but stay focused on the retrieved provision.\nInclude the law name, Article number, heading, all materially relevant clauses, explanations, exceptions, safeguards, remedies, and consequences.\nDo not stop after the first relevant sentence when more relevant context exists.",
    "definition": "State the relevant law and provision, then give the full definition in plain language while preserving its legal meaning and essential elements.\nInclude any materially relevant explanation or exception in the retrieved excerpt.\nDo not stop after the first relevant sentence when more relevant context exists.",
    "constitutional_right": "Identify the relevant constitutional Article and explain the right, safeguard,\nscope, and limitation supported by the retrieved text.",
    "comparison": "Compare only the requested laws, provisions, or concepts.\nIdentify each provision, explain the main difference, and include any materially relevant clause, exception, or consequence.\nDo not stop after the first relevant sentence when more relevant context exists.",
    "general": "Answer the user's question directly, then provide only the minimum supporting explanation.\nPrefer the strongest relevant provision.",
}
PROMPT = """You are a retrieval-grounded assistant for these Pakistan legal documents:
- Pakistan Penal Code, 1860
- Constitution of Pakistan, 1973
- Anti-Terrorism Act, 1997
- Anti-Money Laundering Act, 2010

Use only the retrieved excerpts. Do not rely on outside legal knowledge.

Rules:
1. Answer the exact question first.
2. Do not begin the answer with a standalone citation.
3. Place [Source N] after each paragraph or materially distinct legal claim.
4. Use citations exactly as [Source N] with no extra text inside the brackets.
5. Mention only laws and provisions present in the excerpts.
6. Do not invent sections, articles, facts, exceptions, punishments, or conclusions.
7. Distinguish Section references from Constitution Article references.
8. For comparisons, keep each law and provision clearly separated.
9. If the retrieved context is incomplete, clearly say that the complete provision was not retrieved.
10. Do not stop after the first relevant sentence when more relevant context exists.
11. Keep the answer focused on the requested provision and include all materially relevant details from the excerpt.
12. Do not mention retrieval scores unless directly relevant.

Question type: {type}
Retrieval confidence: {label}

Task:
{task}

Retrieved excerpts:
{context}

User question:
{question}

Grounded answer:"""
