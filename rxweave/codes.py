"""Fixed values of the two wire formats: identifiers are the contract, message texts are this library's own."""

from __future__ import annotations

FS, GS, RS = "\x1c", "\x1d", "\x1e"

#: Request header: name, width.
REQUEST_HEADER = (
    ("binNumber", 6), ("versionRelease", 2), ("transactionCode", 2), ("processorControlNumber", 10), ("transactionCount", 1),
    ("serviceProviderIdQualifier", 2), ("serviceProviderId", 15), ("dateOfService", 8), ("softwareCertificationId", 10),
)
#: Response header: name, width.
RESPONSE_HEADER = (
    ("versionRelease", 2), ("transactionCode", 2), ("transactionCount", 1), ("headerResponseStatus", 1), ("serviceProviderIdQualifier", 2), ("serviceProviderId", 15),
)
REQUEST_HEADER_LENGTH = sum(n for _, n in REQUEST_HEADER)
RESPONSE_HEADER_LENGTH = sum(n for _, n in RESPONSE_HEADER)
RESPONSE_HEADER_MIN_LENGTH = 6
SEGMENT_ID_LENGTH = 2

SEGMENT_NAMES = {
    "01": "Patient", "02": "Pharmacy Provider", "03": "Prescriber", "04": "Insurance", "05": "Coordination of Benefits / Other Payments", "07": "Claim",
    "08": "DUR / PPS", "10": "Compound", "11": "Pricing", "12": "Prior Authorization", "13": "Clinical", "20": "Response Message", "21": "Response Status",
    "22": "Response Claim", "23": "Response Pricing", "24": "Response DUR / PPS", "25": "Response Insurance", "26": "Response Patient",
    "28": "Response Coordination of Benefits / Other Payers",
}
FIELD_NAMES = {
    "AM": "Segment Identification", "C1": "Group ID", "C2": "Cardholder ID", "C3": "Person Code", "C4": "Date of Birth", "C5": "Patient Gender Code",
    "D2": "Prescription / Service Reference Number", "EM": "Prescription / Service Reference Number Qualifier", "D3": "Fill Number",
    "D7": "Product / Service ID", "E1": "Product / Service ID Qualifier", "E7": "Quantity Dispensed", "D5": "Days Supply",
    "D8": "Dispense As Written / Product Selection Code", "DB": "Prescriber ID", "EZ": "Prescriber ID Qualifier", "AN": "Transaction Response Status",
    "F3": "Authorization Number", "FA": "Reject Count", "FB": "Reject Code", "FQ": "Additional Message Information", "F5": "Patient Pay Amount",
    "F6": "Ingredient Cost Paid", "F7": "Dispensing Fee Paid", "F9": "Total Amount Paid", "FM": "Basis of Reimbursement Determination", "F4": "Message",
    "J6": "DUR / PPS Response Code Counter", "E4": "Reason For Service Code", "FS": "Clinical Significance Code", "FT": "Other Pharmacy Indicator",
    "FU": "Previous Date Of Fill", "FV": "Quantity Of Previous Fill", "FW": "Database Indicator", "FX": "Other Prescriber Indicator",
    "FY": "DUR Free Text Message", "E5": "Professional Service Code", "E6": "Result Of Service Code", "8E": "DUR / PPS Level Of Effort",
    "J9": "DUR Co-Agent ID Qualifier", "H7": "DUR Co-Agent ID", "EF": "Compound Dosage Form Description Code",
    "EG": "Compound Dispensing Unit Form Indicator", "EC": "Compound Ingredient Component Count", "RE": "Compound Product ID Qualifier",
    "TE": "Compound Product ID", "ED": "Compound Ingredient Quantity", "EE": "Compound Ingredient Drug Cost",
    "UE": "Compound Ingredient Basis Of Cost Determination", "4C": "Coordination Of Benefits / Other Payments Count", "5C": "Other Payer Coverage Type",
    "6C": "Other Payer ID Qualifier", "7C": "Other Payer ID", "E8": "Other Payer Date", "HC": "Other Payer Amount Paid Qualifier",
    "DV": "Other Payer Amount Paid", "6E": "Other Payer-Patient Responsibility Amount Qualifier", "7E": "Other Payer-Patient Responsibility Amount",
    "NT": "Other Payer ID Count", "MH": "Other Payer Processor Control Number", "NU": "Other Payer Cardholder ID", "MJ": "Other Payer Group ID",
    "EU": "Prior Authorization Type Code", "EV": "Prior Authorization Number Submitted",
}
RESPONSE_DISPOSITIONS = {"P": "paid", "C": "captured", "A": "approved", "D": "duplicate", "Q": "duplicate", "F": "deferred", "R": "rejected"}
RESPONSE_STATUS_NAMES = {
    "P": "Paid", "C": "Captured", "A": "Approved", "D": "Duplicate of Paid", "Q": "Duplicate of Captured", "F": "Prior Authorization Deferred", "R": "Rejected",
}
POSITIVE_DISPOSITIONS = ("paid", "captured", "approved", "duplicate")
REJECT_CODES = {
    "25": "Missing/Invalid Prescriber ID", "41": "Submit Bill To Other Processor Or Primary Payer", "54": "Non-Matched Product/Service ID Number",
    "65": "Patient Is Not Covered", "70": "Product/Service Not Covered", "75": "Prior Authorization Required", "76": "Plan Limitations Exceeded",
    "79": "Refill Too Soon", "88": "DUR Reject Error", "AG": "Days Supply Limitation For Product/Service", "M1": "Patient Not Covered",
}
DUR_REASONS = {
    "DD": "Drug-Drug Interaction", "TD": "Therapeutic Duplication", "ID": "Ingredient Duplication", "HD": "High Dose", "LD": "Low Dose", "ER": "Early Refill",
    "LR": "Late Refill / Underutilization", "MC": "Drug-Disease Contraindication", "PG": "Pregnancy Precaution", "PA": "Drug-Age Precaution",
}
PRODUCT_QUALIFIERS = {"00": "Not Specified", "01": "UPC", "02": "HRI", "03": "NDC"}
CODE_SYSTEMS = {
    "ND": "NDC", "NDC": "NDC", "RXNORM": "RXNORM", "RXCUI": "RXNORM", "SNOMED": "SNOMED", "SCT": "SNOMED", "NCI": "NCI", "ICD10": "ICD10", "ICD-10": "ICD10",
}
#: Last character of a zoned amount: the digit it stands for, positive then negative.
OVERPUNCH_POSITIVE, OVERPUNCH_NEGATIVE = "{ABCDEFGHI", "}JKLMNOPQR"

CLAIM_FATALS = {
    "EMPTY_INPUT": "nothing but white space", "NO_HEADER": "too short for a header",
    "INVALID_FRAMING": "no separator after the header", "UNSUPPORTED_VERSION": "the version stamp is not supported",
}
CLAIM_WARNINGS = {
    "VF6_NOT_DECODED": "a newer version whose body is left undecoded", "UNKNOWN_SEGMENT": "a segment id outside the table",
    "MALFORMED_FIELD": "a field token too short for an id", "MISSING_SEGMENT_ID": "a segment that doesn't start with its id",
    "MALFORMED_SEGMENT_ID": "a segment id that isn't two characters", "MULTI_TRANSACTION_TRUNCATED": "only the first transaction is decoded",
    "STATUS_CONFLICT": "rejects beside a positive status", "UNKNOWN_REJECT_CODE": "a reject code outside the table",
    "UNKNOWN_RESPONSE_STATUS": "a response status outside the table", "COMPOUND_COUNT_MISMATCH": "another number of ingredients than declared",
    "COB_COUNT_MISMATCH": "another number of other payers than declared", "UNKNOWN_DUR_REASON": "a reason for service outside the table",
}
CLAIM_BUILD_ERRORS = {
    "MISSING_TRANSACTION_CODE": "the transaction code is blank", "EMBEDDED_CONTROL_CHARACTER": "a value holds a separator",
    "MISSING_SEGMENT_ID": "a segment id is blank", "INVALID_FIELD_ID": "a field id isn't two characters",
    "INVALID_SEGMENT_ID": "a segment id isn't two characters", "FIELD_TOO_LONG": "a header value is wider than its place",
}

SCRIPT_FATALS = {
    "EMPTY_INPUT": "nothing but white space", "NOT_XML": "not well-formed XML, or it declares a document type or entity",
    "NO_MESSAGE_ROOT": "the root element isn't Message", "UNSUPPORTED_VERSION": "a legacy dotted version",
}
SCRIPT_WARNINGS = {
    "VERSION_ABSENT": "no version", "UNSUPPORTED_VERSION_TOLERATED": "a version outside the table", "UNSUPPORTED_TRANSACTION": "a transaction that isn't modelled",
    "MISSING_REQUIRED_ELEMENT": "a required element is absent", "STRENGTH_CODED_AND_EXPLICIT": "a coded drug beside an explicit strength; they aren't reconciled",
    "RESPONSE_AMBIGUOUS_DISPOSITION": "more than one response element", "LIFECYCLE_AMBIGUOUS_OUTCOME": "more than one outcome element",
    "LIFECYCLE_OUTCOME_UNRECOGNIZED": "no known outcome element", "SIG_STRUCTURED_LOSSY": "structured directions are decoded in part", "SIG_AMBIGUOUS_DOSE": "a dose element without a readable value",
}
SCRIPT_BUILD_ERRORS = {
    "MISSING_RESPONSE_CODE": "the response code is blank", "MISSING_MEDICATION": "the drug description is blank", "INVALID_CHARACTER": "a value holds a character that XML forbids",
}
KNOWN_SCRIPT_VERSIONS = ("2017071", "2023011")
SCRIPT_TRANSACTIONS = (
    "GetMessage Status Error RxChangeRequest RxChangeResponse RxRenewalRequest RxRenewalResponse Resupply Verify CancelRx CancelRxResponse RxFill "
    "DrugAdministration NewRxRequest NewRx NewRxResponseDenied RxTransferInitiationRequest RxTransfer RxTransferConfirm RxFillIndicatorChange Recertification "
    "REMSInitiationRequest REMSInitiationResponse REMSRequest REMSResponse RxHistoryRequest RxHistoryResponse PAInitiationRequest PAInitiationResponse PARequest "
    "PAResponse PAAppealRequest PAAppealResponse PACancelRequest PACancelResponse PANotification"
).split()
LIFECYCLE_REQUESTS = ("RxRenewalRequest", "RxChangeRequest", "CancelRx")
LIFECYCLE_RESPONSES = ("RxRenewalResponse", "RxChangeResponse", "CancelRxResponse")
#: The first of these that is present decides.
RESPONSE_KINDS = ("Error", "Status", "Verify")
OUTCOMES = {
    "Denied": "denied", "DenyNewToFollow": "deniedNewToFollow", "ApprovedWithChanges": "approvedWithChanges", "Approved": "approved", "Validated": "validated", "Replace": "replace",
}
RESPONSE_MEANING = {"Status": "success", "Error": "error", "Verify": "verify"}
APPROVALS = {
    "approved": "affirmative", "approvedWithChanges": "affirmative", "denied": "negative", "deniedNewToFollow": "negative",
    "replace": "indeterminate", "validated": "indeterminate", "unknown": "indeterminate",
}
#: Components of structured directions: element names in the order in which they are looked for.
SIG_COMPONENTS = {
    "doseDeliveryMethod": ("DoseDeliveryMethod",), "dose": ("DoseQuantity", "Dose"), "doseUnitOfMeasure": ("DoseUnitOfMeasure",),
    "route": ("RouteOfAdministration", "Route"), "siteOfAdministration": ("SiteOfAdministration", "Site"),
    "administrationTiming": ("AdministrationTiming", "TimingAndDuration", "Frequency"), "duration": ("Duration",), "vehicle": ("Vehicle",),
    "indication": ("Indication",), "maximumDoseRestriction": ("MaximumDoseRestriction",),
}
#: Identifications: member, element.
IDENTIFICATIONS = {"npi": "NPI", "deaNumber": "DEANumber", "pharmacyNumber": "NCPDPID"}
#: Elements that are looked for at any depth.
DEEP_ELEMENTS = ("Name", "Gender", "DateOfBirth", "BusinessName", "Identification", "WrittenDate", "SigText", *(n for names in SIG_COMPONENTS.values() for n in names))
#: Elements that are looked for among the children of another.
CHILD_ELEMENTS = (
    "Header", "Body", "Version", "To", "From", "MessageID", "RelatesToMessageID", "SentTime", "PrescriberOrderNumber", "NewRx", *LIFECYCLE_REQUESTS, *LIFECYCLE_RESPONSES, *RESPONSE_KINDS,
    "Response", *OUTCOMES, "ReasonCode", "ReferenceNumber", "DenialReason", "Note", "RequestReferenceNumber", "DescriptionCode", "Description", "Patient", "Pharmacy", "Prescriber", "LastName",
    "FirstName", "MiddleName", *IDENTIFICATIONS.values(), "Date", "Code", "Text", "Qualifier", "CodeSystem", "MedicationPrescribed", "DrugDescription", "DrugCoded", "ProductCode", "DrugDBCode",
    "Strength", "StrengthValue", "StrengthForm", "StrengthUnitOfMeasure", "Quantity", "QuantityUnitOfMeasure", "CodeListQualifier", "Value", "Refills", "NumberOfRefills", "DaysSupply",
    "Substitutions", "Directions", "Sig",
)
