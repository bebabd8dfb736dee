"""Phrase lists of the layer-1 scorers, extraction patterns, stopwords and enumerations. The results depend on them."""

OPENERS = [
    r"^certainly[!.]",
    r"^absolutely[!.]",
    r"^great question[!.]",
    r"^good question[!.]",
    r"^excellent question[!.]",
    r"^interesting question[!.]",
    r"^of course[!,.]",
    r"^sure[!,.]",
    r"^happy to help",
    r"^that'?s (?:a |an )?(?:great|good|excellent|interesting|thoughtful|wonderful|fantastic|really important|important) (?:question|point|topic|observation)",
    r"^what (?:a |an )?(?:great|good|excellent|interesting|thoughtful) (?:question|point)",
    r"^(?:i'?d|i would) be happy to\b",
    r"^i appreciate (?:you|your|the|that|this)",
    r"^thank you for (?:raising|asking|bringing|sharing|this)",
    r"^(?:absolutely|definitely)[!,] let'?s",
    r"^let me (?:walk you through|break this down|help you|provide|share)",
    r"^(?:i'?m|i am) glad you (?:asked|brought|raised|mentioned)",
    r"^when working with\b",
    r"^in (?:modern|today'?s|the modern|the current) [a-z]+ (?:workflows?|systems?|environments?|practice)",
    r"^in the (?:context|world|realm) of\b",
]

# One phrase can match several of these; the matches add up. With each pattern: strings of which every match holds one.
HEDGES = {
    r"\b(?:it'?s|it is) worth (?:noting|mentioning|considering|pointing out|examining)\b": (" worth ",),
    r"\b(?:it'?s|it is) important to (?:note|recognize|acknowledge|understand|remember|consider|mention)\b": (" important to ",),
    r"\b(?:it'?s|it is) (?:also )?worth (?:noting|mentioning|considering)\b": (" worth ",),
    r"\b(?:it'?s|it is) essential to (?:note|recognize|understand|consider)\b": (" essential to ",),
    r"\b(?:it'?s|it is) crucial to (?:note|remember|understand)\b": (" crucial to ",),
    r"\bmay potentially\b": ("may potentially",),
    r"\bcould be considered\b": ("could be considered",),
    r"\bone might argue\b": ("one might argue",),
    r"\bto be (?:fair|clear|honest|precise)\b": ("to be fair", "to be clear", "to be honest", "to be precise"),
    r"\b(?:i should|i would|i'?d) (?:note|mention|point out|clarify|add)\b": ("i should ", "i would ", "i'd ", "id "),
    r"\b(?:it'?s|it is) important to acknowledge\b": (" important to acknowledge",),
    r"\b(?:it'?s|it is) also worth mentioning\b": (" also worth mentioning",),
    r"\bone common pitfall\b": ("one common pitfall",),
    r"\bone of the (?:most |key )?(?:common|key|important|critical|notable)\b": ("one of the ",),
    r"\bin general,": ("in general,",),
    r"\bgenerally speaking,": ("generally speaking,",),
    r"\bin many cases,": ("in many cases,",),
    r"\bas a general rule,": ("as a general rule,",),
    r"\bwhat'?s interesting (?:here )?is\b": ("s interesting ",),
}

CONTRACTIONS = [
    r"\b(?:don't|won't|can't|isn't|aren't|wasn't|weren't|hasn't|haven't|hadn't)\b",
    r"\b(?:couldn't|wouldn't|shouldn't|didn't|doesn't)\b",
    r"\b(?:it's|that's|there's|here's|what's|who's|let's)\b",
    r"\b(?:i'm|i've|i'd|i'll)\b",
    r"\b(?:we're|we've|we'd|we'll)\b",
    r"\b(?:they're|they've|they'd|they'll)\b",
    r"\b(?:you're|you've|you'd|you'll)\b",
    r"\b(?:he's|she's)\b",
]

CLOSINGS = [
    r"i hope this (?:helps|gives|provides|was helpful)",
    r"let me know if you (?:have|need|want|would like|'d like)",
    r"feel free to (?:ask|reach out|contact|let me know)",
    r"(?:don't|do not) hesitate to\b",
    r"in conclusion[,.]",
    r"to summarize[,.]",
    r"to sum up[,.]",
    r"in summary[,.]",
    r"happy to (?:discuss|elaborate|help|clarify) further",
    r"if you (?:need|want|have) (?:any )?(?:more|further|additional)",
]

TRANSITIONS = {
    r"\bfurthermore\b": ("furthermore",),
    r"\bmoreover\b": ("moreover",),
    r"\badditionally\b": ("additionally",),
    r"\bin addition\b": ("in addition",),
    r"\bconsequently\b": ("consequently",),
    r"\b(?:it'?s|it is) (?:important|worth|crucial|essential) to (?:note|recognize|understand|consider)\b": (" important to ", " worth to ", " crucial to ", " essential to "),
    r"\bcannot be overstated\b": ("cannot be overstated",),
    r"\bprofound impact\b": ("profound impact",),
    r"\bcritically important\b": ("critically important",),
}

# At the start of a line that may be indented.
BULLET = r"(?<![^\n])[\t\x0b-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]*+(?:[-*•]|\p{Nd}+[.)]) "

NUMBER = (
    r"\$\d[\d,]*(?:\.\d+)?"
    r"|\b\d+(?:[:\-/]\d+){1,2}\b"
    r"|\b\d+(?:,\d{3})+(?:\.\d+)?\b"
    r"|\b\d+(?:\.\d+)+\b"
    r"|\b\d+(?:\.\d+)?\s*%"
    r"|\b\d+(?:\.\d+)?\s*(?:ms|s|sec|min|hr|MB|GB|KB|TB|x)\b"
    r"|\b\d{2,}(?:\.\d+)?\b"
)

ANCHOR = (
    r"\b\d+(?:\.\d+)+\b"
    r"|\b\d{4}\b"
    r"|\b[A-Z]{2,}(?:_[A-Z0-9]+)+\b"
    r"|\b[A-Z]{2,}\b"
    r"|`[^`]+`"
    r"|[\w./-]+\.\w{1,5}\b"
    r"|\b[a-z]+(?:[A-Z][a-z]+)+\b"
    r"|\b\d+\s*(?:ms|s|MB|GB|KB|%|hr)\b"
    r"|\$[\d,]+(?:\.\d+)?"
)

TOKEN = r"[A-Za-z][A-Za-z'.\-]*[A-Za-z]|[A-Za-z]"

GREETING = r"^(?:hi|hey|hello|dear|re:|fyi)(?:\b|:|\s)"

# Capitalised words that name nothing.
STOPWORDS = [
    "I", "A", "An", "The", "This", "That", "These", "Those", "We", "You", "They", "He", "She", "It", "Our", "Their",
    "Your", "His", "Her", "My", "Its", "And", "But", "Or", "If", "When", "While", "Since", "Because", "So", "As", "At",
    "On", "In", "By", "Of", "To", "For", "From", "With", "Without", "Re", "Hi", "Hello", "Hey", "Thanks", "Cheers",
    "Best", "FYI", "Furthermore", "Moreover", "Additionally", "However", "Therefore", "Consequently",
]

DOMAINS = ["blog", "email", "essay", "forum", "social", "technical", "academic"]
SEED_DOMAINS = ["email", "instruction_technical", "blog_opinion", "academic", "creative"]
DISCOURSE_ROLES = [
    "status_update", "request", "decision_rationale", "troubleshooting", "instructional_explanation", "argument_opinion",
    "anecdote", "reflection", "methods", "literature_review", "discussion_limitations", "reported_summary", "scene",
    "narrative_reflection",
]
LENGTH_BANDS = ["short", "medium", "long"]
