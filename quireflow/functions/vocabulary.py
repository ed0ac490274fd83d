"""Fixed word lists. The values decide results, so they are stated plainly; the lists differ and are not to be merged."""

#: Stopwords of the overlap check.
OVERLAP_STOPWORDS = (
    "a an the and or but in on at to for of with by from is are was were be been have has had do does did will would shall "
    "should may might must can could not no this that these those it its as if then than so such each all both into also "
    "about which who what when where how their our we they he she his her him them us me my your"
).split()

#: Stopwords of title phrases.
TITLE_STOPWORDS = (
    "a an the and or but in on at to for of with by from is are was were be been being have has had do does did will would "
    "shall should may might must can could not no nor so yet both either neither than as if its it this that these those "
    "which who whom what when where why how all each every few more most other some such into through during before after "
    "above below between out use using used new based via also their our we"
).split()

#: Keywords of the domains of a reference, in the order that decides ties.
DOMAINS = {
    "medicine": "patient,clinical,disease,therapy,treatment,diagnosis,hospital,trial,cancer,drug,medical,surgery,symptom,imaging,radiology,pathology,epidemiology,cohort,placebo",
    "biology": "gene,protein,cell,molecular,neural,neuron,brain,genome,dna,rna,mutation,organism,species,evolution,metabolic,enzyme,receptor,membrane,tissue,biological",
    "computer_science": "algorithm,neural network,deep learning,machine learning,classification,detection,recognition,optimization,dataset,benchmark,model,architecture,training,accuracy,convolutional,transformer,attention,embedding,inference,latency,gpu",
    "statistics": "regression,bayesian,probabilistic,statistical,variance,distribution,inference,hypothesis,significance,correlation,sampling,estimation,bootstrap,confidence interval,p-value",
    "chemistry": "compound,synthesis,reaction,molecule,catalyst,polymer,solvent,oxidation,spectroscopy,chromatography,titration",
    "engineering": "system,design,sensor,signal,control,hardware,circuit,voltage,frequency,wireless,network,protocol,embedded",
    "social_science": "survey,questionnaire,population,demographic,behavior,psychology,cognitive,social,attitude,intervention,education",
}
#: Keywords of the claim types, in the order of the test; anything else is a finding.
CLAIM_TYPES = {
    "method": "method,technique,algorithm,approach,framework,tool,pipeline,protocol,procedure,system for,using,via,network,architecture,model for,based on",
    "review": "review,meta-analysis,systematic,survey,overview,summary,meta analysis",
    "dataset": "dataset,database,corpus,benchmark,collection,data for,annotated,labeled",
}

#: Headings of sections.
SECTIONS = {
    "abstract": r"(?i)^\s*abstract\s*$",
    "introduction": r"(?i)^\s*(?:\d[\.\s]*)?\s*introduction\s*$",
    "methods": r"(?i)^\s*(?:\d[\.\s]*)?\s*(?:materials?\s+and\s+)?methods?\s*$",
    "results": r"(?i)^\s*(?:\d[\.\s]*)?\s*results?\s*$",
    "discussion": r"(?i)^\s*(?:\d[\.\s]*)?\s*discussion\s*$",
    "conclusion": r"(?i)^\s*(?:\d[\.\s]*)?\s*conclusions?\s*$",
    "references": r"(?i)^\s*(?:references?|bibliography|works\s+cited|literature\s+cited)\s*$",
}
#: What marks the role of a sentence.
OWN_WORK = (
    r"(?i)\b(we\s+(found|show|demonstrate|observe|report|propose|present|develop|introduce|conduct|perform|use|apply|evaluate|compare|analyze|test|train|achieve)|"
    r"our\s+(study|work|results?|findings?|model|method|approach|analysis|experiments?|data)|in\s+this\s+(study|work|paper|article)|"
    r"this\s+(study|work|paper)\s+(presents?|proposes?|describes?|introduces?)|here\s+we|the\s+(present|current)\s+study)\b"
)
TRANSITION = (
    r"(?i)^(however|therefore|thus|hence|furthermore|moreover|in\s+(addition|contrast|summary|conclusion)|on\s+the\s+other\s+hand|despite|although|nevertheless|"
    r"consequently|as\s+(a\s+result|mentioned)|first|second|third|finally|additionally|similarly|in\s+particular)\b"
)
METHOD = (
    r"(?i)\b(method|technique|algorithm|protocol|procedure|approach|framework|tool|software|package|library|pipeline|workflow|model|architecture|network|classifier|"
    r"detector|using|used|employ|implement|apply|following\s+the\s+(?:method|approach|protocol))\b"
)
CLAIM = (
    r"(?i)\b(showed?|demonstrated?|reported?|found|established|proposed?|described?|suggested?|indicated?|revealed?|confirmed?|proved?|"
    r"has\s+been\s+(shown|demonstrated|reported|found|established|proposed|described|suggested)|it\s+(is|has\s+been)\s+(well\s+)?(known|established|shown|demonstrated|reported)|"
    r"studies\s+(have\s+)?(shown|demonstrated|reported|found)|evidence\s+(suggests?|indicates?|shows?)|previously\s+(reported?|described?|demonstrated?|shown)|according\s+to)\b"
)
#: Words near a name that make it an institution.
INSTITUTION = r"(?i)(university|institute|college|laboratory|lab|hospital|school|foundation|center|centre|department|dept|award|prize|association|society|federation|named\s+after|in\s+honor)\b"

#: Word lists of the style detector.
STYLE_STOPWORDS = (
    "a an the and or but if while of in on for to from with without by as at is are was were be been being this that these "
    "those it its their there which who whom what when where why how can could may might will would should also not no such "
    "than then into through"
).split()
STYLE_COMMON = STYLE_STOPWORDS + (
    "important significant various different multiple overall effective complex approach framework context process "
    "development analysis result results study research method methods data information system systems provide provides show "
    "shows suggest suggests"
).split()
STYLE_GENERIC = (
    "important significant effective various multiple complex dynamic critical essential comprehensive robust innovative "
    "context framework approach implications insights outcomes landscape understanding"
).split()
STYLE_HEDGES = "may might could can often generally typically arguably potentially suggests indicates appears".split()
STYLE_TRANSITIONS = "additionally furthermore moreover therefore thus consequently however nevertheless overall".split()
#: Phrase rules with their weights and reasons.
STYLE_PHRASES = (
    (r"\bit is important to note\b", 0.30, "formulaic qualifier"),
    (r"\bit is worth noting\b", 0.28, "formulaic qualifier"),
    (r"\bplays? a (?:crucial|critical|vital|significant) role\b", 0.26, "stock academic phrasing"),
    (r"\b(?:crucial|critical|vital|essential) (?:role|aspect|component)\b", 0.18, "generic emphasis"),
    (r"\b(?:comprehensive|robust|holistic|multifaceted|nuanced) (?:approach|understanding|analysis|framework)\b", 0.24, "generic academic phrasing"),
    (r"\bnot only\b.+\bbut also\b", 0.22, "balanced template structure"),
    (r"\bthis (?:highlights|underscores|emphasizes) the (?:importance|need|significance)\b", 0.22, "formulaic conclusion"),
    (r"\bin (?:today's|the) (?:rapidly evolving|modern|contemporary) (?:world|landscape|era|context)\b", 0.30, "stock opener"),
    (r"\bdelves? into\b", 0.20, "AI-styled verb"),
    (r"\btapestry\b|\bseamless(?:ly)?\b|\bleverage(?:s|d)?\b|\butili[sz](?:e|es|ed|ing)\b", 0.18, "AI-styled vocabulary"),
)
#: What makes a sentence specific.
STYLE_SPECIFIC = r"(?i)\b(?:\d+(?:\.\d+)?%?|\[[0-9, -]+\]|\([A-Z][A-Za-z-]+,\s*(?:19|20)\d{2}[a-z]?\)|(?:19|20)\d{2}|p\s*[<=>]\s*0\.\d+|doi:|https?://)\b"
#: Descriptions of the signals.
STYLE_NOTES = {
    "predictability": "Text uses common, statistically safe wording.",
    "rhythm_uniformity": "Sentence lengths and rhythm are unusually even.",
    "redundancy": "Ideas or phrases repeat across the document.",
    "low_specificity": "Passages lack concrete names, numbers, citations, or details.",
    "style_contrast": "Some passages differ from the document baseline style.",
    "genericity": "Academic-sounding but broad vocabulary appears frequently.",
}
