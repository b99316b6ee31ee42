"""Lookup tables, word lists, patterns and prompt texts.

These must stay exactly as they are, since results are compared with them.
"""

# State code and state name.
STATES = [
    ("AL", "Alabama"), ("AK", "Alaska"), ("AZ", "Arizona"), ("AR", "Arkansas"),
    ("CA", "California"), ("CO", "Colorado"), ("CT", "Connecticut"), ("DE", "Delaware"),
    ("FL", "Florida"), ("GA", "Georgia"), ("HI", "Hawaii"), ("ID", "Idaho"),
    ("IL", "Illinois"), ("IN", "Indiana"), ("IA", "Iowa"), ("KS", "Kansas"),
    ("KY", "Kentucky"), ("LA", "Louisiana"), ("ME", "Maine"), ("MD", "Maryland"),
    ("MA", "Massachusetts"), ("MI", "Michigan"), ("MN", "Minnesota"), ("MS", "Mississippi"),
    ("MO", "Missouri"), ("MT", "Montana"), ("NE", "Nebraska"), ("NV", "Nevada"),
    ("NH", "New Hampshire"), ("NJ", "New Jersey"), ("NM", "New Mexico"), ("NY", "New York"),
    ("NC", "North Carolina"), ("ND", "North Dakota"), ("OH", "Ohio"), ("OK", "Oklahoma"),
    ("OR", "Oregon"), ("PA", "Pennsylvania"), ("RI", "Rhode Island"), ("SC", "South Carolina"),
    ("SD", "South Dakota"), ("TN", "Tennessee"), ("TX", "Texas"), ("UT", "Utah"),
    ("VT", "Vermont"), ("VA", "Virginia"), ("WA", "Washington"), ("WV", "West Virginia"),
    ("WI", "Wisconsin"), ("WY", "Wyoming"), ("DC", "District of Columbia"),
]

# Major cities of a state, most important first.
MAJOR_CITIES = {
    "TX": ["Houston", "Dallas", "Austin", "San Antonio", "Fort Worth", "El Paso", "Arlington", "Plano"],
    "CA": ["Los Angeles", "San Francisco", "San Diego", "San Jose", "Sacramento", "Fresno", "Oakland", "Long Beach"],
    "FL": ["Miami", "Orlando", "Tampa", "Jacksonville", "Fort Lauderdale", "Tallahassee", "St. Petersburg", "Hialeah"],
    "NY": ["New York City", "Buffalo", "Rochester", "Albany", "Syracuse", "Yonkers"],
    "IL": ["Chicago", "Aurora", "Naperville", "Rockford", "Springfield", "Peoria"],
    "PA": ["Philadelphia", "Pittsburgh", "Allentown", "Reading", "Erie", "Scranton"],
    "OH": ["Columbus", "Cleveland", "Cincinnati", "Toledo", "Akron", "Dayton"],
    "GA": ["Atlanta", "Augusta", "Savannah", "Columbus", "Macon", "Athens"],
    "NC": ["Charlotte", "Raleigh", "Greensboro", "Durham", "Winston-Salem", "Fayetteville"],
    "MI": ["Detroit", "Grand Rapids", "Warren", "Sterling Heights", "Ann Arbor", "Lansing"],
}

# How many of those cities a plan must cover at least.
# How many of a state's cities a plan covers at least: a minimum, not a maximum.
MINIMUM_CITIES = {
    "TX": 6, "CA": 6, "FL": 6, "NY": 5, "IL": 5, "PA": 5, "OH": 5, "GA": 5, "NC": 5, "MI": 5,
}

# Company-name endings, removed in this order.
NAME_ENDINGS = [" llc", " inc", " corp", " company", " co"]

# Target defaults.
DEFAULT_INDUSTRY = "businesses"
DEFAULT_DATA_FIELDS = ["company_name", "address", "phone", "website", "email"]

# Search terms made from an industry name.
TERM_PATTERNS = ["{industry}", "{industry} company", "{industry} services", "{industry} provider"]

# Search phrases of a city task.
SEARCH_PATTERNS = [
    "{search_term} in {city}, {state}",
    "{search_term} near {city} {state}",
    "{city} {state} {search_term} companies",
    "best {search_term} {city} {state}",
]

# Columns of the CSV export.
CSV_COLUMNS = [
    "company_name", "city", "state", "address",
    "phone", "website", "email", "industry", "source_task",
]

# Task types and the instruction texts that can exist.
CITY_SEARCH = "city_search"
COMPANY_RESEARCH = "company_research"

# Marks put around prompts.
INSTRUCTION_DIVIDER = "\n\n---\n\n"
WEB_MARK = "@web "

# Prompt texts.
PLANNER_PROMPT = """
Generate research tasks for the following:

Industry: {industry}
States to research: {states}
Search terms to use: {search_terms}
Data fields to collect: {data_fields}

Generate a JSON array of search tasks for each major city in these states.
"""

CITY_SEARCH_PROMPT = """
Search for businesses in:
City: {city}
State: {state}
Industry: {industry}

Search terms to use: {search_terms}
Data fields to collect: {data_fields}

Task ID: {task_id}

Find and return information about relevant businesses in this city.
Output your findings as a JSON object following the format in your instructions.
"""

COMPANY_RESEARCH_PROMPT = """
Research this company:
Company Name: {company_name}
Location: {city}, {state}
Industry: {industry}

Task ID: {task_id}

Gather detailed information about this company.
Output your findings as a JSON object following the format in your instructions.
"""

# Characters counted as blanks at the ends of a text.
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0 "
    "           "
    "    　"
)
