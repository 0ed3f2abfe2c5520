"""Lookup lists used to bucket categories.

Everything in the first block is a FIXED VALUE: it must equal the original
analysis for results to agree, so it is written out plainly, in the order the
original lists it.  The second block holds the equivalents for the adapter
view built from the driver tables (see FIXTURES.md), whose categories are
TPC-H values rather than company names.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES (must equal the original analysis)
# ---------------------------------------------------------------------------

# Companies kept by name; anything else (and null) becomes "Other".
COMPANY_KEEP = [
    "Amazon", "Deloitte", "KPMG", "EY", "PwC", "McKinsey", "Accenture",
    "Boeing", "Facebook", "LinkedIn", "Twitter", "Indeed", "T-Mobile", "AT&T",
    "Bell", "Telus", "Ericsson", "IBM", "Microsoft", "Apple", "Salesforce",
    "Google", "Cisco", "Yahoo", "Walmart", "General Motors", "Samsung",
    "Tesla", "Dell", "Honeywell", "Siemens", "Nike", "Intel",
    "JPMorgan Chase", "Visa", "Paypal", "Bloomberg",
]

# Title ladder: (bucket, titles).  The first arm that lists a title wins, so
# "Senior Director" (in arms 2 and 3) maps to "Product Managers".
TITLE_LADDER = [
    ("Software Engineers", [
        "Software Engineer", "Backend Developer", "Application Developer",
        "Applications Engineer", "Sr Platform Analyst", "Structures Engineer",
        "Systems Development Engineer", "Software Developer",
        "Chase Associate Program", "Software Testing"]),
    ("Product Managers", [
        "Product Manager", "Associate Director", "Director, IT",
        "Advisor Program Manager", "BIE", "Senior Product Manager",
        "Lead Administrator", "Senior Director", "Director of Sales"]),
    ("Engineering Manager", [
        "Software Engineering Manager",
        "Senior Computer Vision Software Engineer", "Senior Principal Engineer",
        "System Engineer", "Solutions Manager", "Lead Software Engineer",
        "Techinical Leader", "Hardware Engineering Manager", "Director of IT",
        "Senior Director"]),
    ("Data", [
        "Data Scientist", "Data Engineer, Data", "Decision Scientist", "BSA",
        "Migration Engineer", "Data Analyst", "Sr. Data Engineer",
        "DATA ANALYST"]),
    ("Seniors and Consultants", [
        "Management Consultant", "Senior QA Engineer", "Senior data scientist",
        "Solution Consultant"]),
    ("Hardware Engineer", [
        "Hardware Engineer", "ASIC design 3", "Solutions Architect"]),
    ("Product Designer", [
        "Product Designer", "Product Design Manager", "Designer",
        "Front End Developer", "UX Architect", "Conversational Designer",
        "User Experience Researcher", "Customer Engineer",
        "Customer Success Manager", "Product Specialist", "Design Engineer"]),
    ("Technical", [
        "Technical Program Manager", "Member of Technical Staff",
        "Network Engineer", "Technical Account Manager",
        "Technical Service Engineer", "technical support engineer"]),
    ("Solution Architect and support", [
        "Solution Architect", "Support engineer", "Cloud Support Engineer",
        "Distinguished Engineer"]),
    ("Management and strategists", [
        "Project Manager", "Investment Banker", "Digital Strategist",
        "Manager – Technology", "System Administrator",
        "Sr. Manager Corporate Strategy", "Associate Principal",
        "Business Development", "Finance, Manager", "Portfolio Manager",
        "Quantitative Analyst", "Business systems analyst",
        "Information Security Manager", "Operations Manager"]),
    ("Sales and marketing", [
        "Marketing Operations", "Financial Analyst",
        "Market Operations Specialist", "Marketing Specialist",
        "Marketing Manager", "Solution Sales Specialist", "Technical Sales",
        "Business", "QE"]),
    ("HR", [
        "Staff Production Planner", "Technical Recruiter",
        "Staffing Services Associate"]),
    ("Other titles", [
        "Civil Engineer", "Quality Assurance Engineer", "Applied Scientist",
        "Fellow", "PhD internship", "Electrical Engineer", "Security Engineer"]),
]

# US state code -> region; any other code (and null) is "US_Southwest".
US_REGIONS = [
    ("US_West", ["WA", "OR", "ID", "MT", "WY", "CA", "NV", "UT", "CO", "AK",
                 "HI"]),
    ("US_Midwest", ["ND", "SD", "NE", "KS", "MN", "IA", "MO", "WI", "IL", "MI",
                    "IN", "OH"]),
    ("US_Northeast", ["PA", "NJ", "NY", "CT", "RI", "MA", "NH", "VT", "ME"]),
    ("US_Southeast", ["WV", "MD", "DC", "DE", "VA", "KY", "NC", "TN", "AR",
                      "LA", "MS", "AL", "GA", "SC", "FL"]),
]
US_DEFAULT = "US_Southwest"

# Country -> region; any other country is "Other".
COUNTRY_REGIONS = [
    ("Canada", ["Canada"]),
    ("Asia1", ["China", "Korea", "Singapore", "Japan"]),
    ("Asia2", ["India", "Indonesia"]),
    ("Europe1", ["Germany", "Ireland", "United Kingdom", "Netherlands",
                 "Switzerland", "Sweden", "Luxembourg"]),
    ("Europe2", ["Poland", "Romania", "Russia", "Bulgaria", "Belarus",
                 "Portugal", "Finland"]),
]
COUNTRY_DEFAULT = "Other"

# Tags kept by name (the 13 most frequent in the original data).
TAG_KEEP = [
    "Full Stack", "Distributed Systems (Back-End)",
    "API Development (Back-End)", "Web Development (Front-End)", "ML / AI",
    "Site Reliability (SRE)", "Networking", "iOS", "Mobile (iOS + Android)",
    "DevOps", "Security", "Android", "Testing (SDET)",
]

# Degrees that set the "master or above" flag; joined with "|" as a regex.
DEGREES = ["Masters", "PhD", "Masters and PhD"]

# Fill constants, location separator, outlier cap, split and models.
OTHER = "Other"
STANDARD_LEVEL_FILL = "Software Engineer"
GENDER_FILL = "Unknown"
OTHER_DETAILS_FILL = "Bachelors"
LOCATION_SEPARATOR = ", "
LABEL_CAP = 1000000
SPLIT_WEIGHTS = [0.7, 0.3]
SPLIT_SEED = 1
TVS_TRAIN_RATIO = 0.75
NUM_FOLDS = 5
MAX_BINS = 37
TOP_K = 10

# Tuning grids.
LINEAR_GRID = {
    "regParam": [1.0, 0.5, 0.1, 0.05, 0.01],
    "fitIntercept": [True, False],
    "elasticNetParam": [0.0, 0.5, 1.0],
}
TREE_GRID = {"maxDepth": [2, 4, 5, 6, 7, 8, 9, 10], "maxBins": [37, 40, 80]}
FOREST_GRID = {"numTrees": [10, 20, 30], "maxDepth": [4, 6, 8, 10]}
BOOSTING_GRID = {
    "maxIter": [10, 20],
    "maxDepth": [4, 7, 10],
    "stepSize": [0.3, 0.1, 0.05, 0.01],
}

# ---------------------------------------------------------------------------
# Adapter lookups (the view of FIXTURES.md over orders and customer)
# ---------------------------------------------------------------------------

ADAPTER_COMPANY_KEEP = ["MACHINERY", "BUILDING", "FURNITURE"]
# "2-HIGH" appears in both arms on purpose: the first arm must win.
ADAPTER_TITLE_LADDER = [
    ("Rush", ["1-URGENT", "2-HIGH"]),
    ("Normal", ["2-HIGH", "3-MEDIUM"]),
]
ADAPTER_TAG_KEEP = ["O", "F"]
