"""Word lists and patterns that decide the text columns.

Everything here must equal the published behaviour for results to match; the
patterns are applied to lower-cased text without word boundaries unless they
carry their own.
"""

# --- sentiment ---------------------------------------------------------------

POSITIVE_STRONG = (
    "excellent|amazing|awesome|fantastic|outstanding|exceptional|superb|brilliant|perfect|love|loved|"
    "best|incredible|wonderful|magnificent|flawless"
)
POSITIVE_MILD = (
    "good|great|nice|satisfied|happy|pleased|decent|fine|solid|useful|helpful|impressed|comfortable|"
    "recommend|recommended|worth|smooth|fast|premium|beautiful"
)
NEGATIVE_STRONG = (
    "terrible|awful|horrible|worst|hate|disgusting|atrocious|abysmal|dreadful|pathetic|unacceptable|"
    "outrageous|furious|fraud|scam|useless|broken|defective"
)
NEGATIVE_MILD = (
    "bad|poor|slow|cheap|disappointed|disappointing|issue|issues|problem|problems|waste|refund|return|"
    "damaged|fake|missing|late|delay|wrong|stopped|unhappy|mediocre|lacking|subpar|inferior"
)
#: Matched as whole words.
NEGATIONS = (
    "not|no|never|neither|nor|barely|hardly|scarcely|doesn't|don't|didn't|isn't|wasn't|won't|wouldn't|"
    "can't|cannot"
)

# --- aspects, complaints, urgency, intent --------------------------------------

ASPECTS = {
    "price": "price|cost|expensive|cheap|value|worth|money|pricing|budget|affordable|overpriced",
    "quality": "quality|build|material|durable|durability|premium|sturdy|finish|craftsmanship|texture|feel",
    "delivery": "delivery|shipping|shipment|arrived|arrival|late|courier|packaging|packed|dispatch|transit",
    "support": "service|support|seller|customer care|customer service|response|resolved|resolution|helpdesk|agent",
    "usability": "easy|difficult|simple|complicated|user.friendly|intuitive|confusing|interface|setup|install|use",
    "performance": "fast|slow|speed|performance|efficient|lag|loading|responsive|quick|smooth|battery|power",
    "design": "design|look|appearance|style|color|colour|aesthetic|attractive|sleek|ugly|size|weight|compact",
    "reliability": "reliable|unreliable|consistent|inconsistent|stable|unstable|crash|bug|error|glitch|stopped working|not working",
    "content": "content|information|description|accurate|inaccurate|misleading|details|specs|features|documentation",
    "comparison": "better than|worse than|compared to|versus|vs|alternative|competitor|similar|unlike|than other",
}
COMPLAINT_TYPES = {
    "billing": "charge|charged|overcharged|billing|invoice|payment|refund|money|price|cost|fee|extra charge",
    "delivery": "late|delay|not delivered|missing|lost|wrong item|shipment|shipping|courier|arrived damaged",
    "quality": "broken|defective|damaged|poor quality|fake|counterfeit|not working|stopped working|malfunction",
    "technical": "error|bug|crash|glitch|not loading|slow|freeze|frozen|not opening|failed|technical issue",
    "support": "no response|rude|unhelpful|ignored|not resolved|bad service|poor support|no help|waiting",
    "policy": "return policy|refund policy|warranty|guarantee|terms|conditions|policy|not accepted|rejected",
}
URGENCY = (
    "urgent|urgently|immediately|asap|as soon as possible|right now|still waiting|been waiting|no response yet|"
    "days? ago|weeks? ago|escalate|escalation|still not|unresolved|follow.?up|reminder|second time|third time|"
    "not yet|haven't received|have not received"
)
#: In order of priority.
INTENTS = {
    "complaint": "complaint|complain|issue|problem|broken|defective|not working|terrible|worst|awful|bad experience|disappointed",
    "inquiry": "how to|how do|what is|where is|when will|can i|is it|does it|do you|please help|need help|want to know",
    "feedback": "feedback|suggest|suggestion|improve|improvement|would be better|should have|wish|hope|feature request",
    "comparison": "better than|worse than|compared to|versus|vs|which one|alternative|recommend between|difference between",
    "recommendation": "recommend|worth buying|should i buy|is it good|good product|love this|excellent product|highly recommend|must buy",
}
SIGNALS = {
    "price_signal": "price|cost|expensive|cheap|value|worth|money|pricing|budget",
    "delivery_signal": "delivery|shipping|shipment|arrived|arrival|late|courier|packaging|packed|box",
    "quality_signal": "quality|build|material|durable|durability|premium|cheap|sturdy|finish|broken|defective",
    "return_refund_signal": "return|refund|replacement|replaced|exchange",
    "support_signal": "service|support|seller|customer care|customer service|response|resolved|resolution",
    "review_pattern_signal": "pros|cons|review|rating|stars|recommend",
}
CURRENCY = r"\$|₹|rs\.?|usd|inr|eur"

# --- stop words -----------------------------------------------------------------

TOPIC_STOPWORDS = (
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "from", "is", "it",
    "its", "this", "that", "these", "those", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do",
    "does", "did", "will", "would", "could", "should", "may", "might", "shall", "can", "not", "no", "nor", "so",
    "yet", "both", "either", "neither", "i", "we", "you", "he", "she", "they", "me", "us", "him", "her", "them", "my",
    "our", "your", "his", "their", "what", "which", "who", "whom", "when", "where", "why", "how", "all", "each",
    "every", "few", "more", "most", "other", "some", "such", "than", "too", "very", "just", "also", "as", "if",
    "then", "into", "about", "up", "out", "there", "here", "get", "got", "like",
)
QUERY_STOPWORDS = (
    "a", "an", "the", "is", "are", "was", "were", "be", "been", "being", "of", "in", "on", "at", "to", "for", "with",
    "about", "as", "by", "and", "or", "but", "if", "so", "do", "does", "did", "please", "can", "could", "would",
    "should", "will", "shall", "me", "you", "i", "we", "it", "this", "that", "these", "those",
)
QUESTION_WORDS = (
    "what|who|whom|when|where|which|why|how|is|are|was|were|does|do|did|can|could|should|would"
)

# --- missing values, canonical names, synonyms ------------------------------------

MISSING_TOKENS = ["", "nan", "null", "none", "n/a", "na", "unknown"]
CANONICAL_NAMES = {
    "product_id": ["product_id", "parent_asin", "item_id", "sku"],
    "customer_id": ["customer_id", "user_id", "buyer_id"],
    "review_text": ["review", "review_text", "feedback", "comment", "comments"],
    "description": ["description", "details", "product_description"],
    "rating": ["rating", "stars", "score", "review_rating"],
    "timestamp": ["timestamp", "date", "created_at", "review_date"],
    "category": ["category", "categories", "product_category"],
    "price": ["price", "cost", "amount"],
    "brand": ["brand", "store", "manufacturer"],
}
COLUMN_SYNONYMS = (
    ("sales", "revenue", "income", "earnings", "turnover"),
    ("price", "cost", "amount", "value", "fee", "charge"),
    ("rating", "score", "grade", "rank"),
    ("count", "quantity", "qty", "number", "volume", "total"),
    ("customer", "client", "user", "buyer", "account"),
    ("product", "item", "sku", "good"),
    ("date", "day", "time", "period", "timestamp"),
    ("category", "type", "class", "group", "segment"),
    ("region", "location", "area", "zone", "territory"),
    ("employee", "staff", "worker", "personnel"),
    ("name", "title", "label"),
    ("id", "identifier", "key", "code"),
)

# --- query labels, signals and routing rules ----------------------------------------

#: In order; the first pattern found decides.
QUERY_TYPES = {
    "comparison": r"\b(vs\.?|versus|compare[sd]?|comparison|difference between|better than|which is)\b",
    "summarization": r"\b(summar(?:y|ize|ise)|tl;?dr|overview of|briefly explain|key points|main points)\b",
    "reasoning": r"\b(if\s.+\sthen|what would happen|implications? of|infer|deduce|conclude|reasoning behind)\b",
    "analytical": r"\b(analy[sz]e|analysis|trend|pattern|correlation|root cause|impact of|breakdown of)\b",
    "explanation": r"\b(why|how does|how do|explain|what causes|reason for)\b",
}
#: Query type: (multiplier of k, change of the threshold, diversity weight).
QUERY_STRATEGY = {
    "search": (0.7, 0.05, 0.3),
    "informational": (1.0, 0.0, 0.4),
    "comparison": (1.6, -0.05, 0.6),
    "summarization": (2.0, -0.10, 0.5),
    "explanation": (1.2, 0.0, 0.3),
    "reasoning": (1.5, -0.05, 0.4),
    "analytical": (1.8, -0.05, 0.5),
    "retrieval": (1.0, 0.0, 0.4),
    "exploration": (1.7, -0.05, 0.65),
    "filtering": (0.8, 0.05, 0.25),
    "aggregation": (1.9, -0.08, 0.45),
    "unknown": (1.0, 0.0, 0.4),
}
#: Signal: (pattern, weight for structured, weight for semantic).
ROUTE_SIGNALS = {
    "aggregation": (r"\b(average|avg|sum|total|count|how many|how much|median|mean|percentage|percent|proportion)\b", 1.0, 0.0),
    "filtering": (r"\b(where|with a|greater than|less than|at least|at most|only|excluding|filter(?:ed)? by|between)\b", 0.8, 0.0),
    "ranking": (r"\b(top|best|worst|highest|lowest|most|least|rank(?:ed|ing)?|leading)\b", 0.8, 0.0),
    "temporal": (
        r"\b(today|yesterday|last (?:week|month|year|quarter)|this (?:week|month|year|quarter)|since|trend|"
        r"over time|\d{4}|monthly|weekly|daily|yearly|quarterly)\b", 0.6, 0.0),
    "comparison": (r"\b(compare|comparison|versus|vs\.?|difference between|better than|worse than)\b", 0.5, 0.3),
    "recommendation": (r"\b(recommend|suggest|should i|what (?:should|would)|advice|which (?:one|option) is)\b", 0.0, 1.0),
    "explanation": (r"\b(why|explain|reason|how does|how do|what causes|because of what)\b", 0.0, 0.9),
    "sentiment": (
        r"\b(feel|feeling|opinion|love|hate|like|dislike|great|terrible|amazing|awful|satisfied|happy|unhappy)\b",
        0.0, 0.8),
    "complaint": (
        r"\b(complain(?:t|ing)?|issue|problem|broken|defective|disappointed|refund|not working|doesn'?t work|faulty)\b",
        0.2, 0.7),
}
FOLLOW_UP_START = r"^\s*(and|also|what about|how about|additionally|furthermore)\b"
BACK_REFERENCE = r"\b(it|that|those|these|the same|the previous one|the last one|them)\b"

#: Label: [(pattern, weight)]; labels in order of declaration.
ROUTING_RULES = {
    "structured": [
        (r"\b(count|average|avg|sum|total|top\s*\d+|highest|lowest|percentage|distribution|rank|group\s+by|aggregate|metric|number\s+of|how\s+many)\b", 1.0),
        (r"\b(table|row|column|field|schema|database|sql|select|where|join|filter|query)\b", 0.8),
    ],
    "trend": [
        (r"\b(trend|increase|decrease|over\s+time|monthly|quarterly|yearly|growth|drop|change|rise|fall|spike|decline|year[- ]over[- ]year|yoy|month[- ]over[- ]month|mom)\b", 1.0),
        (r"\b(since|from\s+\d{4}|between\s+\d{4}|last\s+\d+\s+(month|year|week|quarter))\b", 0.7),
    ],
    "comparison": [
        (r"\b(compare|comparison|versus|vs\.?|difference\s+between|which\s+is\s+better|better\s+than)\b", 1.0),
    ],
    "semantic": [
        (r"\b(opinion|sentiment|feedback|experience|summarize|why\s+do|what\s+are\s+the\s+main|common\s+theme|insight|perception|feel\s+about)\b", 1.0),
        (r"\b(aspect|topic|theme|keyword|phrase|context|meaning|describe|explain|elaborate|nuance)\b", 0.6),
    ],
    "summarization": [(r"\b(summarize|summary|tl;?dr|overview|brief|condense|key\s+points)\b", 1.0)],
    "qa": [(r"\b(what\s+is|who\s+is|when\s+did|where\s+is|define|definition\s+of)\b", 0.9)],
    "entity_lookup": [(r"\b(find|lookup|look\s+up|show\s+me\s+the\s+record|details\s+for|profile\s+of)\b", 0.9)],
}
#: Label: (uses SQL, uses vectors, path).
ROUTES = {
    "structured": (True, False, "SQL"),
    "trend": (True, False, "SQL"),
    "comparison": (True, True, "Hybrid"),
    "semantic": (False, True, "Qdrant"),
    "summarization": (False, True, "Qdrant"),
    "qa": (False, True, "Qdrant"),
    "entity_lookup": (True, False, "SQL"),
    "hybrid": (True, True, "Hybrid"),
}

# --- entities ------------------------------------------------------------------------

ACRONYM = r"\b[A-Z]{2,}\b"
CAPITALISED = r"\b[A-Z][a-zA-Z]{2,}(?:\s+[A-Z][a-zA-Z]{2,})*\b"
DATE_LIKE = (
    r"\b(\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{2,4}|(?:19|20)\d{2}|"
    r"(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?\s+\d{1,2}?,?\s*\d{0,4})\b"
)
METRIC_LIKE = (
    r"\b(\d+(?:\.\d+)?\s?%|\$\s?\d+(?:[.,]\d+)?[kmb]?|"
    r"\d+(?:\.\d+)?\s?(?:kg|lb|km|mi|gb|tb|mb|ms|sec|hrs?|hours?))\b"
)
ROLE_PREFIXES = ["assistant:", "assistant\n", "user:", "user\n", "<|im_start|>"]
DATE_TIME = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2})?(\.\d+)?(Z|[+-]\d{2}:?\d{2})?)?$"
TEXT_NAME_HINTS = (
    "text", "chunk", "body", "content", "description", "review", "summary", "notes", "comment", "message", "abstract",
    "transcript",
)
