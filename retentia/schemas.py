"""Explicit schemas and column contracts; production reads never infer types."""

from __future__ import annotations

from pyspark.sql import types as T

# ---- fixed values: the upload contract -------------------------------------------------------
NUMERIC_FEATURES = [
    "age", "study_hours", "social_media_hours", "netflix_hours", "attendance", "sleep_hours",
    "mental_health_score", "exam_score", "highSchoolGPA", "currentGPA",
]
CATEGORICAL_FEATURES = [
    "gender", "diet_quality", "exercise_frequency", "parental_education", "internet_quality",
    "part_time_job", "extracurricular_activities",
]
BOOLEAN_FEATURES = ["part_time_job", "extracurricular_activities"]
LABEL = "dropout"
ENTITY_ID = "student_id"
REQUIRED_COLUMNS = NUMERIC_FEATURES + CATEGORICAL_FEATURES + [LABEL, ENTITY_ID]
REGRESSION_TARGETS = [
    "age", "highSchoolGPA", "currentGPA", "study_hours", "social_media_hours", "netflix_hours",
    "attendance", "sleep_hours", "mental_health_score", "exam_score",
]
ANOMALY_NUMERIC = ["age", "total_score", "attendance"]
ANOMALY_CODED = ["gender", "class_label"]
# header spellings that name the same field
HEADER_ALIASES = {
    "student ID": "student_id", "Student ID": "student_id", "studentID": "student_id",
    "social_media_time": "social_media_hours", "createdAt": "created_at",
    "Update Date": "update_date", "row_count": "record_count",
}
# ----------------------------------------------------------------------------------------------

_D, _S, _I, _B, _TS = T.DoubleType(), T.StringType(), T.IntegerType(), T.BooleanType(), T.TimestampType()


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


def raw_text_schema(columns) -> T.StructType:
    """Every column as text: the first read of an untrusted CSV delivery."""
    return T.StructType([T.StructField(c, _S) for c in columns])


STUDENT_UPLOAD = T.StructType(
    [T.StructField(ENTITY_ID, _S)]
    + [T.StructField(c, _D) for c in NUMERIC_FEATURES]
    + [T.StructField(c, _S) for c in CATEGORICAL_FEATURES]
    + [T.StructField(LABEL, _S)]
)

ATTENDANCE = _struct(date=_TS, status=_S)
ENROLLMENT = _struct(
    courseId=_S, semester=_S, year=_I, grade=_S, creditsEarned=_I, enrollmentDate=_TS, status=_S,
    attendanceRecords=T.ArrayType(ATTENDANCE),
)
ML_FEATURES = T.StructType(
    [T.StructField(c, _D) for c in NUMERIC_FEATURES]
    + [T.StructField(c, _S) for c in CATEGORICAL_FEATURES]
)
PREDICTION = T.StructType([
    T.StructField("class", _I), T.StructField("probability", _D),
    T.StructField("recommendations", T.ArrayType(_S)), T.StructField("model_used", _S),
    T.StructField("timestamp", _TS),
])
STUDENTS = _struct(
    userId=_S, studentID=_S, name=_S, dateOfBirth=_TS, ethnicity=_S, socioeconomicStatus=_S,
    entranceExamScores=T.MapType(_S, _D), financialAidStatus=_S, riskFactors=T.ArrayType(_S),
    notes=T.ArrayType(_S), dropoutPredictionScore=_D, enrollmentHistory=T.ArrayType(ENROLLMENT),
    lmsActivitySummary=_struct(lastLoginDate=_TS, totalLogins=_I, avgTimeOnLMSPerWeek=_D,
                               assignmentsSubmittedCount=_I, quizAverageScore=_D),
    ml_features=ML_FEATURES, prediction=PREDICTION,
)
MODEL_DETAIL = _struct(type=_S, target=_S, model_name=_S, metrics=T.MapType(_S, _D), model_path=_S)
TRAINED_MODELS = _struct(
    _id=_S, dataset=_S, trained_by=_struct(userId=_S, username=_S), created_at=_TS, is_paid=_B,
    details=T.ArrayType(MODEL_DETAIL),
)
UPLOADED_DATASETS = _struct(dataset_name=_S, user_id=_S, is_paid=_B, uploaded_at=_TS,
                            record_count=T.LongType())
LMS_LOGS = _struct(studentId=_S, courseId=_S, activityType=_S, timestamp=_TS,
                   details=T.MapType(_S, _D))
LOGIN_LOGS = _struct(user_id=_S, username=_S, role=_S, timestamp=T.TimestampNTZType())
ALERTS = _struct(alertType=_S, targetEntityId=_S, targetEntityType=T.ArrayType(_S), message=_S,
                 severity=_S, generatedAt=_TS, status=_S, acknowledgedBy=_S, acknowledgedAt=_TS)
NOTIFICATIONS = _struct(user_id=_S, title=_S, body=_S, url=_S, created_at=_TS)
CONTACTS = _struct(name=_S, email=_S, subject=_S, message=_S, created_at=_TS, is_read=_B)
FEEDBACKS = _struct(name=_S, email=_S, message=_S, rating=_I, verified=_B, created_at=_TS)
COURSES = _struct(
    courseCode=_S, courseName=_S, department=_S, credits=_I, prerequisites=T.ArrayType(_S),
    maxCapacity=_I, currentEnrollment=_I, instructorId=_S,
    historicalEnrollment=T.ArrayType(_struct(semester=_S, year=_I, enrollmentCount=_I)),
)
USERS = _struct(_id=_S, username=_S, email=_S, role=_S, is_verified=_B, plan=_S, created_at=_TS,
                last_login=_TS, notifications_enabled=_B, push_subscription=_S)
OTP_CODES = _struct(email=_S, code=_S, created_at=_TS, expires_at=_TS)
SAVED_CHARTS = _struct(collection=_S, x_axis=_S, y_axis=_S, chart_type=_S, limit=_I, color=_S)
