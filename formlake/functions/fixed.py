"""Field patterns, keyword lists and tables that results depend on.

Patterns are written for Python's re; `formlake.functions.text.java` gives them the flags under which Spark reads them alike.
"""

# Field -> (patterns, synonyms) of the whole-text field mapper.
_ADDRESS = r"\s*:?\s*((?:[^\n]+(?:\n[^\n:]+)*?)(?=\s*(?:phone|mobile|contact|tel|email|e-mail|@|\d{10,})|$))"
_DAY = r"\s*:?\s*(\d{1,2}[\-/\.]\d{1,2}[\-/\.]\d{2,4})"
_REST = r"\s*:?\s*([^\n]+)"
_PART = r"\s*:?\s*([^\n,]+)"
NAME_LINES = r"^([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+)\s*$"
MAPPER_FIELDS = {
    "name": ([r"(?:full\s+)?name" + _REST, r"applicant'?s?\s+name" + _REST, r"person\s+name" + _REST, NAME_LINES],
             ["full_name", "applicant_name", "person_name", "student_name"]),
    "father_name": ([r"father'?s?\s+name" + _REST, r"father" + _REST], ["father", "fathers_name"]),
    "mother_name": ([r"mother'?s?\s+name" + _REST, r"mother" + _REST], ["mother", "mothers_name"]),
    "date_of_birth": ([r"(?:date\s+of\s+)?birth" + _DAY, "dob" + _DAY, r"born\s+on" + _DAY], ["dob", "birth_date", "date_birth"]),
    "gender": ([r"(?:sex|gender)\s*:?\s*(male|female|m|f|other)"], ["sex"]),
    "address": (["address" + _ADDRESS, r"residential\s+address" + _ADDRESS, r"permanent\s+address" + _ADDRESS, r"home\s+address" + _ADDRESS],
                ["addr", "residential_address", "home_address", "permanent_address"]),
    "phone": ([r"(?:phone|mobile|contact)\s*(?:no\.?|number)?\s*:?\s*([+\d\s\-\(\)]{10,15})(?!\s*[a-zA-Z])",
               r"(?:tel|telephone)\s*:?\s*([+\d\s\-\(\)]{10,15})(?!\s*[a-zA-Z])",
               r"(?<![\d])([+\d\s\-\(\)]{10,15})(?!\s*(?:address|email|@|[a-zA-Z]{3,}))"],
              ["mobile", "contact_number", "phone_number", "telephone"]),
    "email": ([r"e?-?mail\s*:?\s*([a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,})"], ["e_mail", "email_address"]),
    "city": (["city" + _PART, "town" + _PART], ["town"]),
    "state": (["state" + _PART, "province" + _PART], ["province"]),
    "zip_code": ([r"(?:zip|postal|pin)\s*(?:code)?\s*:?\s*(\d{6})"], ["postal_code", "pin_code", "pincode"]),
    "aadhaar_number": ([r"(?:aadhaar|aadhar|uid)\s*(?:no\.?|number)?\s*:?\s*(\d{4}\s*\d{4}\s*\d{4})", r"(\d{4}\s*\d{4}\s*\d{4})"],
                       ["aadhaar", "aadhar_number", "uid"]),
    "pan_number": ([r"pan\s*(?:no\.?|number)?\s*:?\s*([A-Z]{5}\d{4}[A-Z])"], ["pan"]),
    "passport_number": ([r"passport\s*(?:no\.?|number)?\s*:?\s*([A-Z]\d{7})"], ["passport"]),
    "license_number": ([r"(?:license|licence|dl)\s*(?:no\.?|number)?\s*:?\s*([A-Z0-9\-\/]+)"], ["dl_number", "driving_license", "licence_number"]),
    "voter_id": ([r"(?:voter|epic)\s*(?:id|no\.?|number)?\s*:?\s*([A-Z]{3}\d{7})"], ["epic_number", "voter_id_number"]),
    "occupation": (["occupation" + _REST, "profession" + _REST], ["profession", "job"]),
    "blood_group": ([r"blood\s+group\s*:?\s*([ABO][+-]?)", r"blood\s+type\s*:?\s*([ABO][+-]?)"], ["blood_type"]),
    "marital_status": ([r"marital\s+status\s*:?\s*(married|single|widowed|divorced)"], ["martial_status"]),
    "nationality": (["nationality" + _REST], ["country"]),
    "emergency_contact": ([r"emergency\s+contact" + _REST], ["emergency_number"]),
}

# Field -> (label patterns, value patterns, synonyms) of the line matcher; each asks for a confidence of 0.7.
MATCHER_THRESHOLD = 0.7
MATCHER_FIELDS = {
    "name": ([r"(?:^|\n)\s*(?:name|full\s+name|applicant\s+name|person\s+name)\s*[:]\s*", r"(?:^|\n)\s*(?:name|full\s+name)\s*[=]\s*", r"name\s+is\s+"],
             [r"([A-Z][a-z]+(?:\s+[A-Z][a-z]+)++)"], ["full_name", "applicant_name", "person_name", "fullname"]),
    "date_of_birth": ([r"(?:^|\n)\s*(?:dob|date\s+of\s+birth|d\.o\.b|birth\s+date|birthdate)\s*[:]\s*", r"(?:^|\n)\s*(?:dob|date\s+of\s+birth)\s*[=]\s*"],
                      [r"(\d{1,2}[/-]\d{1,2}[/-]\d{2,4})", r"(\d{4}[/-]\d{2}[/-]\d{2})"], ["dob", "birth_date", "birthdate", "date_of_birth"]),
    "id_number": ([r"(?:^|\n)\s*(?:id|id\s+no|id\s+number|document\s+number|identification\s+number)\s*[:]\s*", r"(?:^|\n)\s*(?:id|id\s+no)\s*[=]\s*"],
                  [r"([A-Z0-9]{8,20})", r"(\d{8,20})"], ["id", "id_no", "id_number", "document_number", "identification_number"]),
    "email": ([r"(?:^|\n)\s*(?:email|e-mail|email\s+address)\s*[:]\s*", r"(?:^|\n)\s*(?:email|e-mail)\s*[=]\s*"],
              [r"([a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,})"], ["e-mail", "email_address"]),
    "phone": ([r"(?:^|\n)\s*(?:phone|mobile|contact\s+number|phone\s+number)\s*[:]\s*", r"(?:^|\n)\s*(?:phone|mobile)\s*[=]\s*"],
              [r"(\+?\d{1,3}[-.\s]?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4})", r"(\d{10})"], ["mobile", "contact_number", "phone_number", "telephone"]),
    "address": ([r"(?:^|\n)\s*(?:address|addr|residential\s+address)\s*[:]\s*", r"(?:^|\n)\s*(?:address|addr)\s*[=]\s*"],
                [r"([A-Za-z0-9\s,.-]{10,})"], ["addr", "residential_address", "home_address"]),
    "aadhaar_number": ([r"(?:^|\n)\s*(?:aadhaar|aadhar|aadhaar\s+number|uid)\s*[:]\s*"], [r"(\d{4}\s?\d{4}\s?\d{4})", r"(\d{12})"], ["aadhar", "uid", "aadhaar_number"]),
    "pan_number": ([r"(?:^|\n)\s*(?:pan|pan\s+card|pan\s+number)\s*[:]\s*"], [r"([A-Z]{5}\d{4}[A-Z])"], ["pan", "pan_card", "pan_number"]),
    "passport_number": ([r"(?:^|\n)\s*(?:passport|passport\s+no|passport\s+number)\s*[:]\s*"], [r"([A-Z0-9]{6,12})"], ["passport", "passport_no"]),
    "license_number": ([r"(?:^|\n)\s*(?:license|licence|driving\s+license|dl\s+no)\s*[:]\s*"], [r"([A-Z0-9]{8,20})"], ["driving_license", "dl", "drl"]),
}

# Document type -> (keywords in lower-cased text, least share, width / height range), in order of precedence.
DOCUMENT_TYPES = {
    "aadhaar_card": ([r"aadhaar", r"aadhar", r"uid", r"unique\s+identification", r"government\s+of\s+india", r"\d{4}\s+\d{4}\s+\d{4}"], 0.4, (1.6, 1.7)),
    "pan_card": ([r"income\s+tax\s+department", r"permanent\s+account\s+number", r"[A-Z]{5}\d{4}[A-Z]", r"father'?s?\s+name"], 0.4, (1.5, 1.7)),
    "passport": ([r"passport", r"republic\s+of\s+india", r"nationality", r"surname", r"given\s+name", r"date\s+of\s+birth", r"place\s+of\s+birth", r"date\s+of\s+issue", r"date\s+of\s+expiry"], 0.5, (0.65, 0.75)),
    "drivers_license": ([r"driving\s+licen[cs]e", r"transport\s+authority", r"vehicle\s+class", r"valid\s+till", r"dl\s+no"], 0.4, (1.5, 1.7)),
    "voter_id": ([r"election\s+commission", r"voter\s+id", r"elector'?s?\s+photo\s+identity\s+card", r"epic"], 0.4, (1.5, 1.7)),
    "birth_certificate": ([r"birth\s+certificate", r"date\s+of\s+birth", r"place\s+of\s+birth", r"father'?s?\s+name", r"mother'?s?\s+name", r"municipal\s+corporation", r"registrar"], 0.5, None),
    "marksheet": ([r"marksheet", r"mark\s+sheet", r"grade\s+card", r"examination", r"university", r"subject", r"marks\s+obtained", r"total\s+marks", r"cgpa", r"percentage"], 0.4, None),
    "application_form": ([r"application\s+form", r"applicant'?s?\s+name", r"date\s+of\s+birth", r"address", r"contact\s+number", r"email", r"signature", r"declaration"], 0.3, None),
    "invoice": ([r"invoice", r"bill\s+to", r"ship\s+to", r"invoice\s+no", r"invoice\s+date", r"subtotal", r"tax", r"total\s+amount", r"gstin"], 0.4, None),
}

# Document type -> recommended fields.
RECOMMENDED = {
    "aadhaar_card": ["name", "aadhaar_number", "date_of_birth", "gender", "address", "father_name"],
    "pan_card": ["name", "pan_number", "father_name", "date_of_birth"],
    "passport": ["surname", "given_name", "passport_number", "nationality", "date_of_birth", "place_of_birth", "date_of_issue", "date_of_expiry", "place_of_issue"],
    "drivers_license": ["name", "license_number", "date_of_birth", "address", "date_of_issue", "valid_till", "vehicle_class"],
    "voter_id": ["name", "voter_id", "father_name", "address", "date_of_birth"],
    "birth_certificate": ["name", "date_of_birth", "place_of_birth", "father_name", "mother_name", "registration_number"],
    "marksheet": ["name", "roll_number", "exam_name", "university", "year", "subjects", "marks_obtained", "total_marks", "percentage", "grade"],
    "application_form": ["name", "date_of_birth", "address", "phone", "email", "father_name", "occupation", "city", "state", "zip_code"],
    "invoice": ["invoice_number", "invoice_date", "company_name", "gstin", "bill_to", "subtotal", "tax", "total_amount"],
}

# Words of the rule cascade, in order.
ID_WORDS = r"aadhaar|pan\s+card|voter\s+id|driving\s+licen[cs]e|drl\s+no"
CERTIFICATE_WORDS = r"certificate|this\s+is\s+to\s+certify|degree|diploma"
FORM_WORDS = r"application\s+form|registration\s+form|form\s+no"

# Form field -> keys that fill it, best first.
FORM_FIELDS = {
    "name": ["name", "full_name", "applicant_name", "person_name"],
    "address": ["address", "addr", "residential_address", "home_address"],
    "phone": ["phone", "mobile", "contact_number", "phone_number", "telephone"],
    "email": ["email", "e-mail", "email_address"],
    "date_of_birth": ["date_of_birth", "dob", "birth_date", "birthdate"],
    "id_number": ["id_number", "id", "id_no", "document_number", "identification_number"],
    "aadhaar_number": ["aadhaar_number", "aadhaar", "aadhar", "uid"],
    "pan_number": ["pan_number", "pan", "pan_card"],
    "passport_number": ["passport_number", "passport", "passport_no"],
    "license_number": ["license_number", "license", "licence", "driving_license", "dl", "drl"],
    "gender": ["gender", "sex"],
    "nationality": ["nationality", "country"],
    "occupation": ["occupation", "profession", "job", "work"],
    "city": ["city"],
    "state": ["state", "province"],
    "zip_code": ["zip_code", "zip", "postal_code", "pincode"],
    "emergency_contact": ["emergency_contact", "emergency", "emergency_phone"],
    "blood_group": ["blood_group", "blood_type", "blood"],
    "marital_status": ["marital_status", "marriage_status"],
    "father_name": ["father_name", "father", "fathers_name"],
}

# Language code -> recogniser's code.
LANGUAGES = {"hin": "hin", "tel": "tel", "tam": "tam", "mal": "mal", "kan": "kan", "ara": "ara", "eng": "eng", "en": "eng"}

# Parts of a field name that choose how values are compared, in order.
NAME_WORDS = ["name", "father", "mother", "guardian", "spouse"]
ADDRESS_WORDS = ["address", "addr", "location", "city", "state"]
NUMBER_WORDS = ["phone", "mobile", "contact", "number", "aadhaar", "aadhar", "pan", "passport", "license", "id", "zip", "pin", "code"]
