"""Labels, bin edges, weights and look-up rows that results depend on."""

# Booking-lead buckets, right-closed, near to far.
BOOKING_EDGES = [-1, 3, 7, 14, 30, 60]
BOOKING_LABELS = ["0-3 days", "4-7 days", "8-14 days", "15-30 days", "31-60 days", "60+ days"]
BOOKING_UPPER_LIMIT = 9999

# Fare bands of the processed observation (seven bands, and the six-band variant).
FARE_BAND_EDGES = [0, 3000, 5000, 7500, 10000, 15000, 25000]
FARE_BAND_LABELS = ["0-3000", "3001-5000", "5001-7500", "7501-10000", "10001-15000", "15001-25000", "25000+"]
FARE_BAND6_EDGES = [0, 3000, 5000, 7500, 10000, 15000]
FARE_BAND6_LABELS = ["0-3000", "3001-5000", "5001-7500", "7501-10000", "10001-15000", "15000+"]

# Buckets of the fare distribution, and the labels the dashboard shows for them.
FARE_BUCKET_EDGES = [0, 5000, 7500, 10000, 15000, 25000, 50000]
FARE_BUCKET_LABELS = ["<=5K", "5K-7.5K", "7.5K-10K", "10K-15K", "15K-25K", "25K-50K", "50K+"]
FARE_BUCKET_DISPLAY = ["<= ₹5K", "₹5K–7.5K", "₹7.5K–10K", "₹10K–15K", "₹15K–25K", "₹25K–50K", "₹50K+"]

# Prototype route weights.
DEFAULT_ROUTE_WEIGHTS = {"DEL-BOM": 0.30, "BLR-DEL": 0.25, "BLR-BOM": 0.20, "DEL-HYD": 0.15, "BOM-HYD": 0.10}

# Index base, default currency, default number of travel days per search spine.
BASE_INDEX = 100.0
DEFAULT_CURRENCY = "INR"
DEFAULT_TRAVEL_DAYS = 7

# Texts that stand for a missing value in a CSV file.
MISSING_TEXTS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>",
                 "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]

# Limits of the query layer.
FLIGHTS_DEFAULT_LIMIT = 100
FLIGHTS_MAX_LIMIT = 1000
RECENT_ROWS = 15
TOP_ROUTES = 25
TOP_AIRLINES = 8
OBSERVATION_PAGE = 15

# Airport master rows (code, city, name, state).
AIRPORTS = [
    ("DEL", "Delhi", "Indira Gandhi International Airport", "Delhi"),
    ("BOM", "Mumbai", "Chhatrapati Shivaji Maharaj International Airport", "Maharashtra"),
    ("BLR", "Bengaluru", "Kempegowda International Airport", "Karnataka"),
    ("HYD", "Hyderabad", "Rajiv Gandhi International Airport", "Telangana"),
    ("MAA", "Chennai", "Chennai International Airport", "Tamil Nadu"),
    ("CCU", "Kolkata", "Netaji Subhas Chandra Bose International Airport", "West Bengal"),
    ("PNQ", "Pune", "Pune International Airport", "Maharashtra"),
    ("AMD", "Ahmedabad", "Sardar Vallabhbhai Patel International Airport", "Gujarat"),
    ("COK", "Kochi", "Cochin International Airport", "Kerala"),
    ("GOI", "Goa", "Goa International Airport", "Goa"),
    ("GOX", "Goa", "Manohar International Airport", "Goa"),
    ("JAI", "Jaipur", "Jaipur International Airport", "Rajasthan"),
    ("LKO", "Lucknow", "Chaudhary Charan Singh International Airport", "Uttar Pradesh"),
    ("GAU", "Guwahati", "Lokpriya Gopinath Bordoloi International Airport", "Assam"),
    ("PAT", "Patna", "Jay Prakash Narayan International Airport", "Bihar"),
    ("IXC", "Chandigarh", "Chandigarh International Airport", "Chandigarh"),
]

# Preferred column order of the processed observation.
PREFERRED_COLUMNS = [
    "record_id", "search_id", "origin", "destination", "route", "outbound_date", "return_date",
    "collection_timestamp", "collection_date", "searched_at", "advance_purchase_days",
    "booking_window_category", "airline", "flight_type", "currency", "price", "total_fare", "base_fare",
    "taxes_fees", "stops", "total_duration_minutes", "departure_time", "arrival_time", "travel_class",
    "carbon_emissions_kg", "seats_available", "sold_out", "booking_token", "source", "source_engine",
    "travel_year", "travel_month", "travel_week", "travel_day", "travel_day_of_week", "travel_day_name",
    "travel_month_name", "is_weekend", "collection_hour", "fare_band", "log_fare", "fare_outlier",
    "route_average_fare", "fare_vs_route_average_pct", "route_airline_count", "route_observation_count",
    "search_currency", "search_timestamp", "search_request_id",
]
