"""The small labelled table of the personal-information tagger: annotated sentences, written by rule.

Sentences hold slots in braces; {EMAIL}, {PHONE}, {ID} (the words for an identity number and its value),
{ADDRESS} and {NAME} are labelled with their kind, all other slots are filled and not labelled. Names,
streets, cities and mail hosts are put together from syllables, so that the tagger has to learn from shapes
and surroundings, not from lists. No sentence is taken from a corpus that the tagger is used on.
"""

from __future__ import annotations

import random

KINDS = ("EMAIL", "PHONE", "ID_NUMBER", "ADDRESS", "NAME")

# Sentences with personal information.
POSITIVE = """
mail: {EMAIL}|Drop us a line at {EMAIL}|{EMAIL} works best for invoices.|we tried {EMAIL} and it bounced|Could someone forward this to {EMAIL}?|Replies should land in {EMAIL}, thanks.|From: {EMAIL}
To: {EMAIL}\nSubject: your ticket|her inbox is {EMAIL}|Old login was {EMAIL}, new one {EMAIL}.|Newsletter goes to {EMAIL} every week|I signed up using {EMAIL} in spring.|You have {EMAIL} on record, is that right?|({EMAIL})|Why was {EMAIL} removed?
user contact={EMAIL} verified=true|"mail":"{EMAIL}","lang":"en"|{"login": "{EMAIL}", "active": true}|{"id": "{item}", "owner": {"email": "{EMAIL}"}}|{"customer": "{user}", "email": "{EMAIL}", "zip": "{zip}"}|My partner uses {EMAIL} and I use {EMAIL}.|{EMAIL}, please
ring {PHONE} any time|Phone {PHONE}|call me at {PHONE}|Mobile: {PHONE}|Our office line is {PHONE}, ask for the night shift.|Text messages to {PHONE} arrive quickly.|The number {PHONE} was busy.|Try {PHONE} or else {PHONE}.|You rang from {PHONE}?
Whatsapp {PHONE} if nobody opens|Tel. {PHONE}, fax {PHONE}|reach her under {PHONE} on weekdays|Somebody left a voicemail from {PHONE} about it.|Is it {PHONE} or did I note it wrong?|I changed my number to {PHONE} in May.|contact number {PHONE} (home)|{PHONE} please, not the old one
"tel": "{PHONE}"|{"mobile":"{PHONE}","opt_in":false}|{"user": "{user}", "phone": "{PHONE}", "status": "{status}"}|{"name": {"first_name": "{First}", "last_name": "{Last}"}, "contact": {"phone": "{PHONE}"}}|Just dial {PHONE}.|Phone number on the slip reads {PHONE}; it rings out.
{Id} {IDV}|{Id}: {IDV}|My {ID}.|my {ID} is what the bank wanted|They copied the {ID} from the photo.|Please delete the {ID} you stored.|for the visa we sent {ID} twice|the {ID}|a {ID} on paper|your system kept the {ID}|give the {ID} to nobody|was the {ID} needed?|they print the {ID}!|I typed {ID} into the chat by accident|Her {ID} got printed on the receipt!|Verification failed for {ID}
you may use {ID}, but keep that quiet|the scan shows {ID} on page two|Would {ID} do as proof?|He read out his {ID} over the line.|With the {ID} you can confirm who I am.|"ssn": "{ssn}"|{"tax_number": "{tax}", "country": "{City}"}|{"passport_no": "{passport}", "valid": true}|{"user": "{user}", "ssn": "{ssn}"}|{"user": "{user}", "tax_id": "{tax}"}
The van waited outside {ADDRESS}.|Home is {ADDRESS}.|I now rent at {ADDRESS}|Our shop sits at {ADDRESS}, ground floor.|Send the spare parts to {ADDRESS}.|please use {ADDRESS} for parcels|The flat, {ADDRESS}, is empty until June.|Was {ADDRESS} ever on my file?|Address: {ADDRESS}
Return label printed for {ADDRESS}|ship to {ADDRESS}|{ADDRESS}|Collect it from {ADDRESS} before noon.|He moved from {ADDRESS} to {ADDRESS}.|my parents live at {ADDRESS}; leave it there|{ADDRESS} - third bell from the top|We never lived at {ADDRESS}.|Could the courier come to {ADDRESS} instead?|It went to {ADDRESS}, a place I left years ago.
"street": "{ADDRESS1}"|{"address1": "{ADDRESS1}", "address2": "", "city": "{City}"}|{"shipping": {"address1": "{ADDRESS1}", "zip": "{zip}", "country": "US"}}|{"user": "{user}", "address": {"address1": "{ADDRESS1}", "city": "{City}"}}|Invoice to {NAME}, {ADDRESS}.|Parcel for {NAME}, {ADDRESS}, tel {PHONE}.|{NAME}, {ADDRESS}|drop it with {NAME} at {ADDRESS}
Speaking: {NAME}.|I'm {NAME}, hello|hi, this is {NAME} again|My husband {NAME} ordered it.|Kind wishes, {NAME}|Cheers\n{NAME}|Yours sincerely\n{NAME}|ask for {NAME} at reception|{NAME} took the call yesterday.|It was {NAME} who complained first.|Booked by {NAME}.
The account holder, {NAME}, agreed.|registered on {NAME}|Attn: {NAME}|Name on card: {NAME}|Cardholder {NAME}|Our contact there is {NAME} from accounting.|{NAME} wrote back within an hour.|Has {NAME} confirmed?|I gave the keys to {NAME} this morning.|the gift is from {NAME}, with love|Signature: {NAME}|You spoke to {NAME} about that.
{NAME} and {NAME} share the account.|tell {NAME} I said hi|the letter names {NAME} as the buyer|my daughter {NAME} picked it up|"name": "{FULL}"|{"full_name":"{FULL}","age":44}|{"user": "{user}", "name": {"first_name": "{First}", "last_name": "{Last}"}, "status": "{status}"}|{"recipient": "{FULL}", "order": "{order}"}|customer {NAME} ({EMAIL})|{NAME} <{EMAIL}>|{NAME}, {PHONE}
Neighbours say {NAME} accepted the delivery.|Refund the voucher to {NAME}.|Please correct the spelling to {NAME}.|{NAME} received it on {date}.|handed over to {NAME} at the gate|Then {NAME} came to the door.|We are {NAME} and family.|Written by {NAME} on {date}|cc {NAME}|{NAME} here.|On behalf of {NAME}, I ask you to {verb} it.
"""

# Words before and after a name, and before and after an address; each two make a sentence.
BEFORE_NAME = "|||ask|tell|with|from|by|for|to|see|call|is|was|was that|is it|I am|I'm|it's|that's|here is|here's|this is|the name's|her name is|named|known as|my son|my wife|my boss|my flatmate|our tenant|the buyer|the tenant next door|colleague|give it to|leave it with|left with|deliver to|hand this to|brought by|paid by|sold to|booked for|signed|regards,|best,|thank you,|bye,|yours,|owner:|guest:|buyer -|contact:|meet|between us,|a cheque by|a message for|ordered by|present for|put|mention|inform|my name is|name is|my full name is|call me|I go by|we are|he is|she is|thank|let|because|so|then|and|but|maybe|when|did|has|does|would|could|where is|who is".split("|")
AFTER_NAME = "|||.|!|?|,|speaking|here|next door|upstairs|instead|again|please|signed|signed it|packed it|took it in|has the keys|has it|is my boss|lives there|asked for it|did not answer|called twice|would know|who called|who paid|who wrote|if in doubt|when in doubt|about it|, thanks|, my friend|, our neighbour|, write to {EMAIL}|, mail {EMAIL}|, phone {PHONE}|, {PHONE}|on the box|on the form|on the list|in the lobby|, {ADDRESS}|, {ADDRESS}, {PHONE}|, {ADDRESS}, or ring {PHONE}|- {thing}|and me|on {date}|'s parcel|for {usd}|regarding {order}".split("|")
BEFORE_ADDRESS = "|||at|to|from|near|in|is|was|we live at|living at|moved to|staying at|goes to|went to|left at|dropped at|deliver to|send to|sent to|bring it to|billed to|bill to|forward to|fetch it from|label:|new address:|home:|it says|it reads|should read|should be|not {ADDRESS} but|change to|use|try|for {NAME},|{NAME},|office,|is there parking at|do you serve|van stopped at".split("|")
AFTER_ADDRESS = "|||.|?|,|please|instead|now|today|until May|from June on|next week|not the other one|not here|which is old|which is right|is wrong|is right|is ours|is where we live|is where he waits|on your route|in your area|by mistake|and call {PHONE}|, and ring {PHONE}|, {NAME}|, attention {NAME}|- thanks|on {date}|with {order}".split("|")

# Sentences without personal information, many of which look as if they had some.
NEGATIVE = """
parcel 1Z{d2} {d4} {d4} {d2} is still in transit|Shipment code 1Z{d2}{d4}{d4}{d2}|ping @{word} on the board|replace <{KIND}> before sending|[{KIND}] was blacked out already|Fields marked {KIND}_REDACTED stay hidden.|case {d4}-{d3}-{d3} got closed|Build {d1}.{d2}.{d1} fixed it|voucher {XX}-{d3}-{d3} has expired|voucher {XX}{d4}
Model {d3}-{d2}X by {Brand}|case number {d4}-{d2}-{d3}, no news|The {Brand} {Noun} shelf looks fine|{Brand} {Noun} is out of print|ends in {d4}|card ending {d4}, as shown|serial {d10} on the sticker|serial number {d10}|Hall {d2} near {place}|Same place as last time.|Nobody answers the hotline.|request {uuid}|id={uuid}|billed on {pay}|{user} is my handle
Battery at {d2} percent.|There is a typo in the title.|Could you {verb} my {colour} {Brand} {thing}, it is {order}?|Swap that {Brand} {thing} against the {size} one in {colour}.|First the {Brand} {thing}, the rest afterwards.|One more {Brand} {thing} waits in my cart.|Why do I see the {Brand} {thing} twice below {order}?|What is the price of the {Brand} {thing}, {size}?
A {thing} plus a {Brand} {thing} come with it.|{order} ({status}) includes one {Brand} {thing}.|We stock the {Brand} {thing} as {colour} or {colour}.|{verb} all of {order}, please|Charge {pay}, never {pay}.|{order} amounts to {usd}|profile {user}|The {usd} from {pay}, where did it go?|No more than {usd} for a {thing}, please.|Row {item} lists one {thing}.|I count {d2} parcels, two are mine.
Right, {verb} {order} then.|Keep {order}, but {verb} that {thing}.|Tracking claims {status}, {date}.|Only {d2} of them should be {verb}ed.|They put the {thing} in {place}.|Your colleague offered to {verb} it {when}.|{when} someone promised {colour}.|Does any {thing} come in {material}?|{material} {thing}, {colour}: on sale?|I'd rather have {size} than {size}.|Its {material} matches my {thing}.|Move the money onto {pay}.
Nobody asked me whether to {verb} {order}.|{d2} days remain for that.|Read {order} back, will you?|Sum, please.|Both the {thing} and that {thing} belong in {place}.|Is a {thing} part of the {usd}?|{order}: {status}, as ever.|It is {material}, though I chose {material}.|Cheapest {thing} in {colour}?|For {usd} we can {verb} the {colour} {thing}.|{item}: {thing}, {colour}.|Your wish to {verb} {order} has been noted.
{order} left us on {date}.|{usd} will return to {pay}.|{item} is gone in {colour}.|Expect the {material} {thing} around {date}.|The gap comes to {usd}.|After the swap you owe {usd}.|A supervisor takes over from here.|The {thing} travels to your saved place.|{user} has {d2} ways to pay.|{d2} kinds of {thing}, {d2} in stock.|{pay} paid for the {thing}.|You want to {verb} one {thing} but not the other.
{order} cannot be {verb}ed, it shows {status}.|{size} is on hold for you.|{size} or {size}?|The new one: {material}, {size}.|Its state is {status}.|One yes from you and I start.|A single exchange per {order} is allowed.|{thing} and {thing} travel together.|Heavier in {colour}, but {usd}.|{size}, {material}: {usd}.|Anything more?|Enjoy the weekend!|Bear with me.|Gladly.|Kindly give me a mail address or a full name with postcode.
Act as the clerk of a shop: follow the rules, confirm each step. Version {d1}.|On the train at the moment.|That belongs elsewhere.|Staying around {City} till Sunday.|{City} is foggy.|Rain over {City} again|The {City} {Team} beat the {City} {Team}.|{City} {Team} tickets|{Org} sent the bill|Ask {Org} about it.|flights from {City} to {City}|{City} Town Hall|the {City} branch closed|Made in {City} by {Org}.
{"order": "{order}", "state": "{status}", "lines": [{"sku": "{item}", "title": "{thing}", "amount": {money}}]}|{"lines": [{"sku": "{item}", "title": "{Brand} {thing}", "amount": {money}}, {"sku": "{item}", "amount": {money}}]}|{"sku": "{item}", "name": "{thing}", "price": {money}, "options": {"color": "{colour}"}}|{"order_id": "{order}", "items": [{"name": "{thing}", "item_id": "{item}"}]}
It fell off the table, yet runs.|Second box is missing.|He has it.|Leave it outside.|Someone at home placed it.|Too little credit on it.|Wrong item.|Ask inside.|On the sticker, please.|Quite calm.|Not sure at all.|Sorry.|That upset us.|Dark in there, and heavy.|bring it to the old house|we went abroad in autumn|at the office, rather|I feel lost and would love more detail.|Display flickers in the rain.|Write when he is late.|Twice at the bell.|After six.
For my niece.|I was told so at the counter.|Is my former place still saved?|Side entrance.|It was not signed.|You changed the terms and said nothing.|A mess: cracked lid, bent hinge.|They look alright, one seam is open.|Give me a minute while you check.|Weeks late, wet carton, bent edge.|Okay, proceed.|What load can that shelf take?|yes or no?|It says handle with care.|Close to the harbour now.|Moved in March.|Back door, two knocks.|Tomorrow, at the counter.
Until summer, everything.|They asked my size.|Attached, see below.|A bill for customs.|Noted down badly.|My word on it.|Take the order code for that.|{"city": "{City}"}|{"city": "{City}", "zip": "{zip}"}|{"user": "{user}", "city": "{City}"}|{"zip": "{zip}", "country": "US"}|as the owner demanded|maybe its owner can tell|{"error": "no such order"}|Error: no such user|{"user": "{user}", "balance": {money}}|{"code": "1Z{d2}{d4}{d4}{d2}", "by": "{Brand}"}|Thank you, {First}!|{First} speaking.|Hi {First},
Dear {First},|The {Brand} {thing} has a scratch.|{Brand} {thing}|the {Brand}|{Brand} and {Brand} make both|item {d10}|items {d10} and {d10}|product {d10} or {d10}|{Day} or {Day}?|in {Month}|{Month} {d2}|Status: {status}|Total {usd}|Ref {d3}{d4}|Room {d3}|Gate {d2}, platform {d1}|floor {d1}|Chapter {d2}, section {d1}.{d1}|at {d2}:{d2} sharp|{d1} of {d2} steps|{d2} {thing}s|between {date} and {date}|score {money} of {d2}
{"items": [{"name": "{thing}", "item_id": "{item}", "price": {money}}]}|{"name": "{thing}", "price": {money}}|{"item_id": "{item}", "name": "{thing}", "price": {money}}|[{"item_id": "{item}", "name": "{thing}", "price": {money}}, {"item_id": "{item}", "name": "{thing}", "price": {money}}]|"name": "{thing}"|{"order": "{order}", "goods": [{"id": "{item}", "name": "{thing}"}, {"id": "{item}", "name": "{colour} {thing}"}]}
{"id": "{order}", "status": "{status}", "items": [{"item_id": "{item}", "name": "{thing}", "price": {money}}]}|{"product_name": "{thing}", "variants": {d2}}|{"name": "{thing}", "product_id": "{item}", "variants": {"{item}": {"available": true, "price": {money}}}}|final digits {d4}|the digits {d4} ring a bell|pin {d4}|since {d4}|year {d4}|code {d4}, level {d1}|digits: {d4}|the last ones are {d4}|{d4} points|we have {d4} of them|page {d3}, line {d2}
ask again later|tell us more|put it back on the shelf|put the {thing} on top|see the {thing} below|call the shop|is the {thing} blue|with care|thanks a lot|regards from the team|my new {thing}|my old {thing} broke|it's the {thing} again|that's all|here is the {thing}|I am quite happy|I am rather tired|I'm not at home|this is {colour} {thing}|a present for my niece|the {thing} next door|the {thing} is wrong|is the {thing} in stock
how much is it|how much for the {Brand} {thing}?|how many {thing}s are left|how long does it take|how often do you {verb} them|how soon|so how much do I pay|which one do you mean|what else would it need|when does it close|where did it go|why so late|who can {verb} it|who would know|I am late already|I am afraid it broke|I am waiting since {when}|I am off to {place}|my name is misprinted|ask before you {verb} it|put both on one bill|put everything in one parcel|thanks for the quick reply|the cheaper {colour} {thing} will do|a {colour} {thing} for {usd}|any {material} {thing} left?
"""

# Openings and endings of sentences.
OPENINGS = "Evening,|Morning!|So,|Fine,|Yes but|Frankly,|Hmm,|Oh,|Listen,|Quick one:|PS:|Note:|FYI,|Also,|And then,|Another point:|Wait,|Please,|Btw|Again:|Agent:|Customer:|As far as I know,|Currently,|Meanwhile,|Perhaps|Apologies,|Great,|Sure,|Certainly,|Noted.|Done.|Indeed,|However,|Besides,|At last,|Then again,|Earlier you wrote:|He said:".split("|")
ENDINGS = ", if that helps|, and nothing besides|by tonight|, near {place}|, though {colour} sold out|since it broke|, see {when}|, never {colour}|with the sum|, else explain|, once you can|but spare the {thing}|, row {item}|, from {date} on|through {pay}|, {order} aside|within {d2} days|; no way back after that|, a gap of {usd}|, whose fan is loud|, as it drains fast|, which bothers me|, I am no expert|, so be it|; it smells odd|, the tint is off|by mistake|unless you charge for it|, our trip fell through|, given it is {status}|, the voucher is short|; go on?|and that is all|, with a note|, one sleeve is short|, it drips|, wheels squeak|, time is short|, I am new here|, pages are missing|, drawers jam|, {colour}|, bought {when}|, then {usd}".split("|")

# Fillers.
FILLERS = {
    "verb": "cancel|return|swap|change|track|resend|upgrade|review|check|split|merge|pause|reorder|refund|repair".split("|"),
    "colour": "black|white|navy|brown|turquoise|ivory|pink|maroon|grey|bronze|golden|oak|orange|violet|sky blue|dark green|red|blue|yellow|green".split("|"),
    "material": "linen|wool|pine|iron|cane|cotton|glass|suede|clay|nylon|tin|plastic|velvet|marble|felt".split("|"),
    "thing": "kitchen scale|e-bike|e-book|T-shirt|two-seater|hand-held mixer|x-ray apron|pull-over|tea-cosy|garden chair|wool blanket|phone case|reading glasses|rice cooker|raincoat|ladder|tool box|tea towel|salad bowl|desk fan|door mat|candle holder|alarm clock|fishing rod|board game|cushion cover|shower curtain|storage bin|flower pot|ironing board|music stand|paint brush|shopping bag|steam mop|bread knife|winter gloves|swim goggles|tennis racket|cable reel|night light|lunch box|wine rack|step stool|coat hanger|pencil set|travel pillow|dog leash|sewing kit|freezer|curtain|stool|kettle|rug|lamp|bench|mirror|drill|jacket|helmet|speaker|camera|keyboard".split("|"),
    "size": "tiny|mid-size|big|huge|size 8|size 40|size 12|the double|the single|the corner one|250 g|2 litres|10 inch|24 inch|XL".split("|"),
    "status": "open|shipped|packed|lost|on hold|sent back|in review|paid|draft".split("|"),
    "place": "the shed|the hallway|our cellar|the gym|my uncle's barn|an attic in town|the porch|the cabin|the lab|the nursery|a colleague's desk".split("|"),
    "when": "last night|at noon|on Monday|a month ago|in the holidays|the other day|a minute ago|at breakfast|last winter".split("|"),
    "KIND": "EMAIL|PHONE|NAME|ADDRESS|ID|MASKED|REDACTED".split("|"),
    "word": "orders|support|returns|billing|help".split("|"),
    "Noun": "Oak|Birch|Classic|Seven|Amber|Grand|Elm|Cedar".split("|"),
    "Team": "Lions|Rangers|Tigers|United|Rovers|Hawks|Wanderers|Athletic|Eagles|Kings".split("|"),
    "Day": "Monday|Tuesday|Wednesday|Thursday|Friday|Saturday|Sunday".split("|"),
    "id_words": "social security number|SSN|ssn|national insurance number|NI number|tax id|tax number|VAT number|passport|passport number|identity card|national id|ID card|driver's licence|driving licence|licence number".split("|"),
    "title": "Mr|Mr.|Mrs|Mrs.|Ms|Ms.|Dr.|Dr|Herr|Frau|Señora|Señor|Prof.|Madame|Sir|Miss".split("|"),
    "street_kind": "Street|St.|St|Road|Rd|Rd.|Avenue|Ave|Ave.|Lane|Ln|Drive|Dr|Court|Ct|Way|Terrace|Boulevard|Blvd|Close|Place|Square|Crescent|Walk|Quay|Row|Grove|Hill|Mews|Gardens|Park|Path|Rise|View|Alley|Parade|Gate|Green|Yard".split("|"),
    "unit": "Apt|Suite|Unit|Apt.|Flat|Floor|#|Room".split("|"),
    "Month": "January|February|March|April|May|June|July|August|September|October|November|December".split("|"),
    "first": "Anna|James|Maria|Peter|Sofia|Omar|Lucas|Emma|Noah|Fatima|Ivan|Chen|Aisha|Pedro|Nina|Karl|Julia|Mateo|Olga|Hugo|Clara|Yuki|Amir|Laura|Jonas|Irene|Tomas|Helen|Bruno|Leila|Marc|Vera|Stefan|Carmen|Ravi|Grace|Felix|Ines|Anton|Marie|Jürgen|José|Zoë|Søren|Priya|Wei".split("|"),
    "tld": "example|test|invalid|com|org|net|de|co.uk|io|fr".split("|"),
}
ONSETS = "b br c ch d dr f fl g gr h j k kr l m n p qu r s st t th tr v w y z".split()
NUCLEI = "a e i o u ai ei ie oa ou".split()
CODAS = "l n r s t ck ld lm nd ng rk rn sk st th x".split()
LAST_ENDINGS = "son berg man sen ard ell ow ick ine ova stad ley ton wood well mere holm vik sky brook field lin dale".split()
PLACE_ENDINGS = "wood field bridge moor ton ford dale hill water gate brook crest ley bend mill".split()


class Writer:
    """Fills sentences; each piece is a list of (text, kind or None)."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def syllables(self, n: int, ending: list[str]) -> str:
        r = self.r
        return "".join(r.choice(ONSETS) + r.choice(NUCLEI) + (r.choice(CODAS) if r.random() < 0.4 else "") for _ in range(n)) + r.choice(ending)

    def last(self) -> str:
        r = self.r
        name = self.syllables(r.choice((1, 1, 2)), LAST_ENDINGS).capitalize()
        if r.random() < 0.08:
            name = r.choice(("Mc", "O'", "Mac", "D'")) + name
        if r.random() < 0.08:
            name += "-" + self.syllables(1, LAST_ENDINGS + [""]).capitalize()
        return name

    def first(self) -> str:
        r = self.r
        made = lambda: r.choice(FILLERS["first"]) if r.random() < 0.4 else self.syllables(r.choice((1, 2)), ["a", "n", "ia", "o", "el", "ik", "s", "e"]).capitalize()
        x = r.random()
        return f"{made()}-{made()}" if x < 0.06 else f"{made()} {made()}" if x < 0.1 else made()

    def name(self) -> str:
        r, x = self.r, self.r.random()
        first, last = self.first(), self.last()
        if x < 0.16:
            out = f"{r.choice(FILLERS['title'])} {last}"
        elif x < 0.32:
            out = f"{last}, {first}"
        elif x < 0.46:
            out = f"{first} {r.choice('ABCDEFGHJKLMNPRSTVW')}. {last}"
        elif x < 0.5:
            out = f"{r.choice(FILLERS['title'])} {first} {last}"
        else:
            out = f"{first} {last}"
        y = r.random()
        return out.upper() if y < 0.13 else out.lower() if y < 0.36 else out

    def email(self) -> str:
        r, x = self.r, self.r.random()
        first, last = self.first().lower().replace(" ", ""), self.last().lower().replace("'", "")
        user = r.choice((f"{first}.{last}", f"{first}_{last[:3]}{r.randint(1, 99):02d}", f"{first[0]}{last}", f"{last}{r.randint(1, 999)}", f"{last}+orders", f"{first}"))
        host = self.syllables(r.choice((1, 2)), ["mail", "net", "post", "box", "lin", ""])
        host = (r.choice(("home.", "mail.", "in.")) if r.random() < 0.12 else "") + host + "." + r.choice(FILLERS["tld"])
        if x < 0.45:
            out = f"{user}@{host}"
        elif x < 0.55:
            out = f"mailto:{user}@{host}"
        elif x < 0.63:
            out = f"<{user}@{host}>"
        elif x < 0.73:
            out = f"{user}[@]{host}"
        elif x < 0.78:
            out = f"{user}[at]{host.replace('.', '[dot]')}"
        elif x < 0.87:
            out = f"{user} at {host.replace('.', ' dot ')}"
        else:
            out = f"{user} (at) {host.replace('.', ' (dot) ')}"
        return out.upper() if r.random() < 0.1 else out

    def digits(self, n: int) -> str:
        return "".join(self.r.choice("0123456789") for _ in range(n))

    def phone(self) -> str:
        d, r = self.digits, self.r
        a = r.choice((
            f"{d(3)}-{d(3)}-{d(4)}", f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"+1 {d(3)} {d(3)} {d(4)}", f"{d(3)}-{d(3)}-{d(4)} ext. {d(r.choice((2, 3)))}",
            f"+44 {d(2)} {d(4)} {d(4)}", f"0{d(2)} {d(4)} {d(4)}", f"+49 {d(2)} {d(5)} {d(3)}", f"0049 (0){d(2)} / {d(5)}-{d(3)}", f"+{d(2)} {d(1)} {d(2)} {d(2)} {d(2)} {d(2)}",
            f"{d(3)} {d(3)} {d(4)}", d(10), "0" + d(10), f"{d(3)}-{d(4)}", f"+1-{d(3)}-{d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)} x{d(3)}",
        ))
        if r.random() < 0.05:
            words = "zero one two three four five six seven eight nine".split()
            a = " ".join(words[int(c)] for c in d(r.choice((7, 10))))
        return a

    def id_value(self, words: str) -> str:
        d, r = self.digits, self.r
        letters = lambda n: "".join(r.choice("ABCDEFGHJKLMNPQRSTUVWXYZ") for _ in range(n))
        if "social" in words or "ssn" in words.lower():
            return r.choice((f"{d(3)}-{d(2)}-{d(4)}", f"{d(3)} {d(2)} {d(4)}", d(9)))
        if "insurance" in words or "NI" in words:
            return r.choice((f"{letters(2)} {d(2)} {d(2)} {d(2)} {letters(1)}", f"{letters(2)}{d(6)}{letters(1)}"))
        if "tax" in words or "VAT" in words:
            return r.choice((f"{d(2)}-{d(7)}", f"{d(2)} {d(3)} {d(3)} {d(3)}", f"DE{d(9)}"))
        if "passport" in words:
            return r.choice((f"{letters(2)} {d(7)}", f"{letters(1)}{d(8)}", d(9), f"no. {letters(1)}{d(8)}"))
        if "licence" in words:
            return r.choice((f"{letters(2)}-{d(4)}-{d(4)}", f"{letters(1)}{d(3)}-{d(4)}-{d(4)}"))
        return r.choice((f"{d(3)}.{d(3)}.{d(3)}-{d(2)}", f"no. {letters(1)}{d(8)}", f"{letters(1)}{d(8)}", f"{d(8)}-{letters(1)}", f"{letters(2)}{d(7)}"))

    def street(self) -> str:
        r = self.r
        name = self.syllables(r.choice((1, 2)), PLACE_ENDINGS).capitalize()
        if r.random() < 0.3:
            name = r.choice(("Old", "Mill", "Fifth", "Maple", "North")) + " " + r.choice((name, "Orchard", "Race", "Rise")) if r.random() < 0.6 else r.choice((name, "King", "Tanner", "Baker")) + "'s"
        street_kind = r.choice(FILLERS["street_kind"])
        if r.random() < 0.04:
            name = name.lower()
            street_kind = street_kind.lower()
        return f"{'no. ' if r.random() < 0.05 else ''}{r.choice((self.digits(1), self.digits(2), self.digits(3), self.digits(4))).lstrip('0') or '7'}{',' if r.random() < 0.12 else ''} {name} {street_kind}"

    def city(self) -> str:
        name = self.syllables(1, PLACE_ENDINGS).capitalize()
        return name + self.r.choice(("", "", "", " Falls", " Landing", " Bay", " Mills", " Heath")) if self.r.random() < 0.85 else self.r.choice(("Port ", "Nether ", "Upper ", "Saint ")) + name

    def address(self) -> str:
        r, x = self.r, self.r.random()
        if x < 0.17:
            return f"{r.choice(('P.O. Box', 'PO Box', 'P. O. Box', 'Post Office Box'))} {self.digits(r.choice((3, 4)))}" + (f", {self.city()}" if r.random() < 0.8 else "")
        if x < 0.3:
            way = self.syllables(2, ["weg", "straße", "strasse", "allee", "platz", "gasse"]).capitalize()
            return f"{way} {r.randint(1, 140)}, {self.digits(5)} {self.city()}"
        if x < 0.4:
            return f"{r.choice(('Calle', 'Avenida', 'Plaza', 'Rue', 'Via'))} {r.choice(('', '', '', 'del ', 'de la ', 'de '))}{self.syllables(2, ['a', 'os', 'o', 'e']).capitalize()}{r.choice(('', '', '', ' Viejo', ' Nueva', ' Mayor'))} {r.randint(1, 99)}" + (f", {r.randint(1, 6)}º {r.choice('ABC')}" if r.random() < 0.6 else "") + f", {self.city()}"
        if x < 0.5:
            return f"Flat {r.randint(1, 40)}, {self.street()}, {self.city()}"
        unit = f"{r.choice((' ', ', '))}{r.choice(FILLERS['unit'])} {self.digits(r.choice((1, 2, 3)))}{r.choice(('', '', 'A', 'B'))}" if r.random() < 0.4 else ""
        end = r.choice(("", f", {self.city()}", f" in {self.city()}", f", {self.city()} {self.digits(5)}"))
        return self.street() + unit + end

    def slot(self, name: str) -> list[tuple[str, str | None]]:
        r, d = self.r, self.digits
        if name == "EMAIL":
            return [(self.email(), "EMAIL")]
        if name == "PHONE":
            return [(self.phone(), "PHONE")]
        if name == "NAME":
            return [(self.name(), "NAME")]
        if name == "FULL":  # as a field holds it
            return [(f"{self.first()} {self.last()}", "NAME")]
        if name == "thing" and r.random() < 0.3:
            return [(" ".join(self.syllables(1, ["er", "le", "t", "ing", "s", ""]) for _ in range(r.choice((1, 2, 2, 3)))), None)]
        if name == "ADDRESS":
            text, case = self.address(), r.random()
            text = text.lower() if case < 0.12 else text.upper() if case < 0.16 else text
            street, sep, city = text.rpartition(" in ")
            return [(street, "ADDRESS"), (sep + city, None)] if sep else [(text, "ADDRESS")]
        if name == "ADDRESS1":
            return [(self.street(), "ADDRESS")]
        if name == "ID":
            words = r.choice(FILLERS["id_words"])
            return [(words + " ", None), (self.id_value(words), "ID_NUMBER")]
        if name == "Id":
            self.words = r.choice(FILLERS["id_words"])
            return [(self.words[0].upper() + self.words[1:], None)]
        if name == "IDV":  # of the kind that {Id} has named
            return [(self.id_value(self.words), "ID_NUMBER")]
        if name in ("ssn", "tax", "passport"):
            return [(self.id_value(name), "ID_NUMBER")]
        if name in ("First", "Last"):
            return [(self.first() if name == "First" else self.last(), name)]
        made = {
            "order": lambda: "#W" + d(7), "user": lambda: "usr_" + d(6), "item": lambda: d(10), "usd": lambda: f"${r.uniform(2, 900):.2f}", "money": lambda: f"{r.uniform(2, 900):.2f}",
            "pay": lambda: r.choice(("credit_card", "paypal", "gift_card")) + "_" + d(7), "zip": lambda: d(5), "City": self.city,
            "date": lambda: r.choice((f"{r.randint(1, 28)} {r.choice(FILLERS['Month'])}", f"2031-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}", f"{r.randint(1, 12)}/{r.randint(1, 28)}/2031")),
            "uuid": lambda: "-".join("".join(r.choice("0123456789abcdef") for _ in range(n)) for n in (8, 4, 4, 4, 12)),
            "Brand": lambda: (lambda w: w if r.random() < 0.7 else r.choice((f"{w} Nine", f"Little {w}", f"Saint {w}", f"{w} Street", f"{w} Lane", f"{w} Row", f"Maple {w}", "Baker Row", "Harbour Street", "Maple Lane")))(self.syllables(r.choice((1, 2)), ["ra", "wick", "elle", "ta", "moor", "by", "vane", "ic", "don"]).capitalize()),
            "Org": lambda: r.choice((f"{self.last()} & {self.last()} Ltd", f"{self.city()} City Council", f"Bank of {self.city()}", f"{self.last()} Brothers Inc", f"University of {self.city()}", f"{self.city()} Post Office", f"{self.city()} Airport")),
            "XX": lambda: r.choice("ABCDXYZ") * 2,
        }
        if name in made:
            return [(made[name](), None)]
        if name[0] == "d" and name[1:].isdigit():
            return [(d(int(name[1:])), None)]
        return [(r.choice(FILLERS[name]), None)]

    def sentence(self, pattern: str) -> list[tuple[str, str | None]]:
        out, rest = [], pattern
        while rest:
            head, brace, tail = rest.partition("{")
            out.append((head, None))
            if brace:
                name, close, after = tail.partition("}")
                if close and name.replace("_", "").isalnum():
                    out += self.slot(name)
                    rest = after
                    continue
                out.append((brace, None))
            rest = tail
        if any(k == "Last" for _, k in out):  # a full name in the parts of a record
            out = [(t, "NAME" if k in ("First", "Last") else k) for t, k in out]
        return [(t, k if k in KINDS else None) for t, k in out if t]

    def composed(self) -> str:
        """A pattern of the words before and after a name or an address."""
        r = self.r
        before, kind, after = (BEFORE_NAME, "{NAME}", AFTER_NAME) if r.random() < 0.62 else (BEFORE_ADDRESS, "{ADDRESS}", AFTER_ADDRESS)
        before, after = r.choice(before), r.choice(after)
        pattern = f"{before} {kind}".strip() + ("" if not after or after[0] in ".,!?'" else " ") + after
        return pattern[0].upper() + pattern[1:] if r.random() < 0.5 else pattern

    def text(self, positive: list[str], negative: list[str]) -> list[tuple[str, str | None]]:
        """One to three sentences, often one with personal information."""
        r, out = self.r, []
        patterns = [r.choice(negative) for _ in range(r.choice((0, 0, 1, 1, 2)))]
        if r.random() < 0.72 or not patterns:
            patterns.insert(r.randint(0, len(patterns)), self.composed() if r.random() < 0.45 else r.choice(positive))
        for pattern in patterns:
            if out:
                out.append((r.choice((" ", " ", " ", "\n")), None))
            if not pattern.startswith(("{\"", "\"")) and r.random() < 0.35:
                out.append((r.choice(OPENINGS) + " ", None))
                if r.random() < 0.5:
                    pattern = pattern[0].lower() + pattern[1:] if pattern[1:2].islower() else pattern
            if pattern.endswith(".") and r.random() < 0.25:
                out += self.sentence(pattern[:-1])
                out += self.sentence((lambda e: e if e[0] in ",;" else " " + e)(r.choice(ENDINGS)) + ".")
            else:
                out += self.sentence(pattern)
        x = r.random()
        if x < 0.04:
            out = [(t.upper(), k) for t, k in out]
        elif x < 0.07:
            out = [(t.lower(), k) for t, k in out]
        elif x < 0.2 and len(out) > 2:  # a fragment, as a scanner's context is
            cut = r.randint(1, 12)
            out = [(out[0][0][cut:], out[0][1]) if out[0][1] is None else out[0], *out[1:]]
        return out


def labelled_table(size: int, seed: int = 7) -> list[list[tuple[str, str | None]]]:
    """`size` annotated texts."""
    split = lambda block: [s.replace("\\n", "\n") for line in block.strip().splitlines() for s in line.split("|")]
    writer = Writer(seed)
    return [writer.text(split(POSITIVE), split(NEGATIVE)) for _ in range(size)]
