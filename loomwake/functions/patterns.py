"""Lexical cue groups for messages, as regular expressions to be matched without letter case."""

from __future__ import annotations

# The cue groups and their patterns.
CUES: dict[str, list[str]] = {
    "prompt_injection": [
        r"\b(?:ignore|disregard|override|bypass)\b.{0,60}\b(?:instruction|prompt|policy|rule|router|system)\b",
        r"\b(?:system|assistant|router)\s+(?:instruction|message|note|metadata|override)\b",
        r"\b(?:set|use|force)\s+(?:the\s+)?(?:action|label|confidence|message[_ ]?type)\s*[=:]",
        r"\b(?:mark|classify)\b.{0,40}\b(?:notify|digest|mute|urgent|trusted)\b",
        r"\b(?:action|confidence|verified_business|user_priority)\s*=\s*[a-z0-9_.-]+",
    ],
    "secret_request": [
        r"\b(?:send(?:ing)?|shar(?:e|ing)|reply(?:\s+with)?|enter(?:ing)?|submit(?:ting)?|confirm(?:ing)?|tell(?:ing)?|provid(?:e|ing)|batao|daal\s+do|bhejo)\b[^.!?\n]{0,90}\b(?:otp|pin|password|passcode|cvv|verification\s+code|login\s+code|one[ -]?time\s+password|bank\s+details|card\s+details|account\s+number)\b",
        r"\b(?:otp|pin|password|passcode|cvv|verification\s+code|login\s+code|bank\s+details|card\s+details|account\s+number)\b[^.!?\n]{0,90}\b(?:send|share|reply|enter|submit|confirm|tell|provide|batao|daal\s+do|bhejo)\b",
        r"\bfill\b[^.!?\n]{0,60}\b(?:bank|card|wallet)\s+(?:detail|information)s?\b",
    ],
    "coercive": [
        r"\b(?:act|pay|verify|confirm|open|click|respond|reply|send|share|scan)\s+(?:right\s+)?now\b",
        r"\b(?:immediately|final\s+(?:warning|reminder)|limited\s+window|last\s+chance)\b",
        r"\b(?:account|profile|wallet|access|service|card)\b.{0,70}\b(?:block(?:ed)?|suspend(?:ed)?|restrict(?:ed)?|close[sd]?|expire[sd]?|lock(?:ed)?)\b",
        r"\b(?:warna|jaldi|abhi)\b.{0,70}\b(?:block|band|hold|lock)\b",
    ],
    "unsafe_advice": [
        r"\b(?:stop|skip|discontinue|quit)\b.{0,45}\b(?:medicine|medication|tablet|prescription|insulin|antibiotic)s?\b",
        r"\b(?:replace|instead\s+of)\b.{0,45}\b(?:doctor|treatment|medicine|medication|prescription)\b.{0,60}\b(?:herbal|home\s+remedy|miracle|secret)\b",
        r"\bdoctors?\s+(?:do\s+not|don't|dont)\s+(?:tell|want\s+you\s+to\s+know)\b",
    ],
    "chain": [
        r"\b(?:forward|share|send)\b.{0,45}\b(?:to\s+)?(?:all|everyone|everybody|\d+|ten)\b",
        r"\b(?:do\s+not|don't|dont)\s+(?:ignore|break\s+the\s+chain)\b",
        r"\b(?:good\s+luck|blessing|blessings|positive\s+energy)\b.{0,70}\b(?:forward|share|send)\b",
        r"\b(?:fwd|forwarded)\s+(?:as\s+received|health\s+tip|message)\b",
    ],
    "impersonation": [
        r"\b(?:account|profile|wallet|bank|card|workspace|support|service|access)\b.{0,70}\b(?:security|verification|login|access|block(?:ed)?|restrict(?:ed)?|suspend(?:ed)?|expire[sd]?|stop[sp]?|deactivat(?:e|ed))\b",
        r"\b(?:security|support|verification)\s+(?:alert|team|desk|check|required)\b",
        r"\b(?:refund|reward|benefit|loan|payout)\b.{0,65}\b(?:release|claim|approved|pending|verification)\b",
    ],
    "advance_fee": [
        r"\b(?:loan|reward|benefit|refund|prize|payout)\b.{0,80}\b(?:pay|fee|charge|deposit|token)\b",
        r"\b(?:pay|send)\b.{0,45}\b(?:processing|release|reactivation|clearance|reattempt)\s+(?:fee|charge|amount)\b",
        r"\b(?:processing|release|reactivation|reattempt)\s+(?:fee|charge)\b.{0,65}\b(?:release|claim|approve|deliver)\b",
    ],
    "payment_request": [
        r"\b(?:pay|payment|fee|charge|token|deposit|clearance\s+amount|processing\s+fee)\b",
        r"\b(?:scan|qr|upi|wallet|bank\s+details|card\s+details)\b",
    ],
    "urgency": [
        r"\b(?:urgent|urgently|immediately|asap|right\s+now|call\s+me\s+now)\b",
        r"\b(?:please\s+)?call\s+(?:me\s+)?now\b",
        r"\b(?:leav(?:e|es|ing)|closes?|locks?|expires?|ends?|due)\b.{0,35}\b(?:today|tonight|soon|in\s+\d+\s+min|before|at\s+\d)\b",
        r"\b(?:next|within)\s+\d+\s+(?:minute|minutes|min|mins|hour|hours)\b",
        r"\b(?:today|tonight|tomorrow)\b.{0,45}\b(?:deadline|close[sd]?|leav(?:e|es|ing)|appointment|meeting|pickup|payment|submit|confirm)\b",
        r"\b(?:moved|changed|failed|failing|outside|stuck|alert\s+threshold|rollback)\b",
        r"\b(?:jaldi|abhi|turant|aaj)\b",
    ],
    "non_urgent": [
        r"\b(?:no|nothing)\s+(?:urgent|blocking)\b",
        r"\bno\s+(?:rush|urgency|pressure|need\s+to\s+respond)\b",
        r"\b(?:not|isn't|isnt)\s+time[- ]sensitive\b",
        r"\bwhenever\s+(?:convenient|you\s+can|free)\b",
        r"\b(?:read|check|reply|call)\s+(?:it\s+)?later\b",
        r"\bwe\s+can\s+(?:talk|discuss)\s+tomorrow\b",
        r"\b(?:no\s+need|don't\s+need|do\s+not\s+need)\s+to\s+(?:reply|respond|act|call)\b",
    ],
    "time_constraint": [
        r"\b(?:before|by|till|until|at|after)\s+(?:\d{1,2}(?::\d{2})?\s*(?:am|pm)|noon|midnight|today|tonight|tomorrow)\b",
        r"\b\d{1,2}(?::\d{2})?\s*(?:am|pm)\b",
        r"\b(?:today|tonight|tomorrow|this\s+(?:morning|evening))\b",
        r"\b(?:in|within|next)\s+\d+\s+(?:minute|minutes|min|mins|hour|hours)\b",
        r"\b(?:deadline|time[- ]sensitive|closes?|leav(?:e|es|ing)|window)\b",
        r"\bbefore\s+(?:the\s+)?(?:scheduled\s+time|appointment|pickup|deadline)\b",
        r"\b\d{1,2}\s*(?:minute|minutes|min|mins)\s+me\b",
        r"\b(?:avant|before)\s+\d{1,2}(?::\d{2}|h\d{0,2})?\b",
    ],
    "event": [
        r"\b(?:appointment|meeting|standup|sync|practice|workshop|class|trip|event|potluck|booking|reservation)\b",
        r"\b(?:schedule|scheduled|moved|venue|studio|gate|registration|consent|circular|form|portal)\b",
        r"\b(?:maintenance|repair|water|tanker|elevator|lift|fire\s+alarm|pickup)\b",
    ],
    "payment": [
        r"\b(?:payment|pay|paid|amount\s+due|statement|invoice|receipt|refund|charge|fee|upi|wallet|card)\b",
        r"(?:rs\.?|inr|usd|eur|\$|₹)\s*\d",
    ],
    "business_update": [
        r"\b(?:order|delivery|parcel|shipment|pickup|driver|ride|route|arrival|return|refund|booking)\b",
        r"\b(?:account|statement|appointment|prescription|claim|status|update|packed|scheduled|ready)\b",
        r"\b(?:official|registered)\s+app\b",
    ],
    "promotion": [
        r"\b(?:sale|offer|discount|coupon|promo|cashback|deal|limited[- ]time|shop|buy|off)\b",
        r"\b(?:subscribe|unsubscribe|marketing|selected\s+products|saved\s+items|launch\s+price)\b",
        r"\b\d{1,3}\s*%\s*off\b",
        r"\b(?:itinerary|travel\s+package|per\s+person|first\s+order|launch\s+price)\b",
        r"\b(?:promotion|promotional|advertisement|marketing\s+offer)\b",
    ],
    "marketplace": [
        r"\b(?:selling|for\s+sale|buyer|price\s+final|asking\s+price)\b",
        r"\b(?:dm|message)\s+(?:me\s+)?if\s+(?:interested|serious)\b",
        r"\b(?:photos?|pics?|pictures?)\b.{0,80}\battached\b.{0,80}\bpickup\b",
        r"\b(?:barely|gently)\s+used\b",
    ],
    "marketplace_continuation": [
        r"\b(?:kept|reserved|set)\b.{0,35}\b(?:aside|for\s+you)\b.{0,120}\b(?:still\s+want|confirm|someone\s+else|other\s+(?:people|buyers?)|others?\s+(?:are\s+)?asking)\b",
        r"\b(?:still\s+want|confirm)\b.{0,100}\b(?:offered?|show|release)\b.{0,40}\b(?:someone|anyone|buyer)\s+else\b",
    ],
    "personal_conversation": [
        r"\b(?:can|could|will|would)\s+you\s+(?:call|come|join|confirm|tell|check|pick|collect)\b",
        r"\b(?:call|message|ping)\s+me\b",
        r"\b(?:call|message|ping)\b[^.!?\n]{0,40}\b(?:free|available|convenient)\b",
        r"\bjust\s+checking\s+(?:if|whether)\b",
        r"\banyone\s+(?:watching|joining|coming|interested)\b",
        r"\b(?:we|i)\s+(?:can|might|may|will)\s+(?:talk|discuss|start|meet|join)\b",
        r"\bcall\s+(?:me\s+)?when\s+(?:you(?:'re|\s+are)\s+)?(?:free|available|convenient)\b",
    ],
    "immediate_health_call": [
        r"\b(?:please\s+)?call\s+(?:me\s+)?now\b.{0,120}\b(?:unwell|sick|clinic|hospital|doctor|medical)\b",
        r"\b(?:unwell|sick|clinic|hospital|doctor|medical)\b.{0,120}\b(?:please\s+)?call\s+(?:me\s+)?now\b",
    ],
    "vague_plan": [
        r"\b(?:might|maybe|perhaps|shayad)\b.{0,80}\b(?:plan|meet|thread|poll|discuss|confirm|watch)\b",
        r"\b(?:after\s+dinner|later|raat\s+ko|baad\s+me)\b.{0,70}\b(?:thread|poll|plan|confirm|discuss)\b",
        r"\bno\s+pressure\b",
        r"\b(?:baad|raat)\b.{0,70}\b(?:plan|poll|discuss|dekh|confirm)\b",
    ],
    "first_contact": [
        r"\b(?:found|got)\s+(?:your|this)\s+(?:number|contact)\b",
        r"\bis\s+this\s+[a-z][\w'-]*\b",
        r"\bthis\s+is\s+[a-z][\w'-]*\s+from\b",
    ],
    "lost_item": [
        r"\b(?:found|left|lost)\b.{0,65}\b(?:passport|wallet|phone|keys?|bottle|bag|id\s+card|document)\b",
        r"\b(?:passport|wallet|phone|keys?|bottle|bag|id\s+card|document)\b.{0,80}\b(?:front\s+desk|reception|collect|retrieve|pick\s+up)\b",
        r"\b(?:passeport|portefeuille|telephone|téléphone|cles|clés|document)\b.{0,100}\b(?:trouve|trouvé|retrouver|recuperer|récupérer|reception|réception)\b",
        r"\b(?:trouve|trouvé)\b.{0,80}\b(?:passeport|portefeuille|telephone|téléphone|cles|clés|document)\b",
    ],
    "work_urgency": [
        r"\b(?:prod|production|build|deployment|rollback|queue|job|worker|incident|client|standup|dashboard)\b",
        r"\b(?:retry|retries|alert\s+threshold|escalation|edge\s+case|failed[- ]payment|refund\s+edge\s+case)\b",
    ],
    "operational_alert": [
        r"\b(?:tanker|water\s+supply|motor\s+room\s+valve)\b",
        r"\b(?:main\s+gate|access\s+gate|driveway|repair\s+truck)\b.{0,90}\b(?:close|closing|blocked|move|tow|entry)\b",
        r"\b(?:lift|elevator)\b.{0,80}\b(?:maintenance|repair|closed|stopped|service\s+lift)\b",
        r"\b(?:tank|tanker)\s+aa\s+gaya\b",
        r"\bgate\b.{0,90}\b(?:band|hata\s+do|repair\s+truck|shift)\b",
    ],
    "near_term": [
        r"\b(?:now|immediately|right\s+away)\b",
        r"\b(?:in|within|next|maybe)\s+\d+\s*(?:minute|minutes|min|mins)\b",
        r"\b\d+\s*(?:minute|minutes|min|mins)\s+(?:max|early|left|remaining)\b",
        r"\b(?:leaving|closes?|closing)\b.{0,30}\b(?:soon|now|in\s+\d+|today)\b",
        r"\b\d+\s*(?:minute|minutes|min|mins)\s+me\b",
    ],
    "school_event": [
        r"\b(?:school|teacher|student|child|children|parents?)\b.{0,100}\b(?:bus|trip|consent|circular|timing|list)\b",
        r"\b(?:school\s+circular|field\s+trip|consent\s+note|bus\s+list)\b",
        r"\bschool\s+transport\b|\bschool\b.{0,90}\b(?:pickup|pick[- ]?up|gate|departure|route)\b",
    ],
    "trusted_payment_notice": [
        r"\b(?:payment|maintenance\s+(?:payment|fee)|amount\s+due|fee)\b.{0,100}\b(?:admin|office|official\s+app|society\s+app|receipts?\s+(?:will\s+be\s+)?(?:matched|reconciled))\b",
        r"\b(?:admin|office|official\s+app|society\s+app)\b.{0,100}\b(?:payment|paid|amount\s+due|fee|receipt)\b",
        r"\bmaintenance\b.{0,80}\b(?:closes?|due|deadline)\b.{0,100}\b(?:society\s+app|office\s+qr|receipts?)\b",
    ],
    "business_schedule_change": [
        r"\b(?:pickup|pick[- ]?up|route|driver|arrival|booking|reservation)\b.{0,100}\b(?:moved|changed|rescheduled|instead|new\s+time)\b",
        r"\b(?:moved|changed|rescheduled|instead|new\s+time)\b.{0,100}\b(?:pickup|pick[- ]?up|route|driver|arrival|booking|reservation)\b",
    ],
    "negated_security_payment": [
        r"\b(?:safety|security)\s+advisory\b",
        r"\b(?:never|do\s+not|don't)\s+ask\b.{0,70}\b(?:otp|pin|payment|card|bank)\b",
        r"\bno\s+(?:payment|otp|pin)\b.{0,40}\brequired\b",
    ],
    "greeting": [
        r"\b(?:good\s+(?:morning|afternoon|evening|night)|happy\s+(?:birthday|anniversary)|stay\s+blessed)\b",
        r"\b(?:did\s+you\s+eat|had\s+dinner|take\s+care)\b",
    ],
}

# Words too common to compare messages by.
STOP_WORDS = """a an and are as at be been before but by can dear do for from had has have hello hi i if in is it me my of on or our please so that the their this to we with you your""".split()

# Link shorteners, and top-level domains that make a bare name a host.
SHORTENERS = """bit.ly tinyurl.com t.co goo.gl ow.ly is.gd cutt.ly rb.gy""".split()
BARE_HOST_ENDINGS = """com org net in io co app info xyz top site online link me ly gd gl""".split()
