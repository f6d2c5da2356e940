"""The sentences that answers are made of."""

# --- fixed values: per decision (direct answer, legal basis, practical meaning, important limits); {0} is the first reference, {1} the first summary in lower case, {2} the first summary ---
ANSWERS = {
    "none": (
        "There is not enough retrieved legal information to answer that question reliably.",
        "No retrieved legal provision supports an answer to this question.",
        "You would need more relevant legal sources before drawing a reliable conclusion.",
        "This response is limited by the absence of supporting retrieved evidence.",
    ),
    "weak": (
        "The retrieved material is too weak to support a reliable answer.",
        "The strongest retrieved source was {0}, but its support is not strong enough to rely on.",
        "The system should avoid making a confident legal statement from weak evidence.",
        "This is legal information only, not legal advice, and the evidence is currently insufficient.",
    ),
    "ambiguous": (
        "The retrieved sources point to more than one plausible provision, so I cannot give a single grounded answer.",
        "Relevant retrieved sources include:",
        "The current evidence suggests related provisions, but not one clearly dominant answer.",
        "This response is limited by ambiguity in the retrieved evidence and should not be treated as legal advice.",
    ),
    "broad": (
        "The retrieved evidence does not fully answer this broader question. The closest source is {0}, which addresses {1}",
        "The closest retrieved provision is {0}. It addresses {1}",
        "In plain English, the current retrieved material is narrower than the question you asked, so it should be treated as only partial legal information.",
        "This is legal information, not legal advice. More directly relevant provisions may be needed before drawing a reliable conclusion.",
    ),
    "grounded": (
        "The retrieved sources indicate that {2}",
        "{0} indicates that {2}",
        "In plain English, this is the main point supported by the retrieved legal text.",
        "This is legal information, not legal advice. The answer may depend on facts that are not covered in the retrieved sources.",
    ),
}
MORE_SOURCES = "Additional supporting sources:"
NO_SOURCES = "- No supporting sources retrieved."
# --- fixed values: the checklist for employment agreements; (category, cues, item, basis) in the order of the answer ---
CHECKLIST = [
    ("written_terms", ["contracts to be in writing", "contract of service"], "Written contract terms: check whether the contract is in writing and whether termination terms are stated.", "{0} supports checking whether the contract of service is recorded in writing and includes termination terms."),
    ("wages", ["wage", "deduction"], "Salary, wages, deductions, and benefits: check how wages are paid and whether deductions are lawful.", "{0} supports checking wage and deduction terms before you agree to them."),
    ("hours", ["hours of work", "overtime", "rest day"], "Working hours, overtime, and rest days: check the stated hours, overtime expectations, and rest-day arrangements.", "{0} supports checking working-time protections such as hours of work, overtime, or rest days."),
    ("leave", ["annual leave", "sick leave", "holiday"], "Leave and holidays: check annual leave, sick leave, and holiday-related entitlements.", "{0} supports checking leave and holiday entitlements."),
    ("termination", ["termination"], "Termination and notice: check how much notice is required and what happens when the contract ends.", "{0} supports checking notice and termination terms."),
    ("rights", ["trade union", "discrimination", "favourable", "flexible working arrangement"], "Employee protections and rights: check whether the terms appear consistent with employee protections recognized in the retrieved provisions.", "{0} supports reviewing employee-protection or workplace-rights issues reflected in the retrieved sources."),
]
CHECKLIST_SUBJECTS = ["employment agreement", "employment contract", "contract of service"]
CHECKLIST_ASKS = ["before signing", "signing", "protect myself", "protect yourself", "need to check", "should i check", "what should i check"]
NOTICE = "notice of termination"
WITHOUT_TERMS = "Job scope and key written terms: practical check only; the retrieved legal sources here do not directly set out a complete clause-by-clause contract checklist."
NO_BASIS = "No retrieved legal provision clearly supports a checklist item."
CHECKLIST_ANSWER = "Before signing an employment agreement, the retrieved sources support checking whether the contract terms are written clearly, what notice or termination terms apply, and what the agreement says about wages, leave, working conditions, and employee protections."
CHECKLIST_LIMITS = "This is legal information, not legal advice. The retrieved provisions support only part of a broader employment-agreement checklist, so practical items like job scope or negotiation points should not be treated here as legal conclusions unless a retrieved source covers them."
# --- fixed values: words that say nothing about content ---
CONTENT_STOPWORDS = ["a", "act", "agreement", "an", "and", "are", "be", "do", "does", "employment", "for", "how", "i", "in", "is", "law", "my", "of", "on", "or", "that", "the", "this", "to", "under", "what", "which"]
