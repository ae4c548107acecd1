"""Spark types of tensors, requests and responses, and the names and thresholds that all modules share."""

from __future__ import annotations

TENSOR = "struct<shape: array<bigint>, data: array<float>>"
REQUEST = "model string, images array<string>"
YOLO_RESPONSE = "struct<class_names: array<string>, results: array<array<struct<class_id: int, confidence: float, bbox: array<int>>>>>"
OCR_RESPONSE = "struct<results: array<array<struct<line: string, confidence: float, bbox: array<int>>>>>"

# Error codes, versions, kinds, frameworks, providers and options by their exact names.
ERROR_CODES = [
    "kOK", "kUnimplementedError", "kCustomError", "kUnknownError", "kRuntimeError",
    "kRangeError", "kParameterError", "kIOError", "kDeviceError", "kModelError",
]
YOLO_VERSIONS = ["kVCustom", "kV10", "kV11"]
OCR_VERSIONS = ["kPPOCRv3", "kPPOCRv4", "kEasyOCR"]
FRAMEWORKS = ["kCUSTOM_FRAMEWORK", "kONNXRUNTIME", "kTVM"]
PROVIDERS = ["kCUSTOM_EP", "kCPU", "kDML", "kCUDA", "kTensorRT", "kRKNPU", "kVulkan", "kOpenGL", "kOpenCL"]
OPTION_DEFAULTS = {"static_path": "assets/static", "infer_framework": "kONNXRUNTIME", "infer_ep": "kCPU", "infer_device": "0"}
DEFAULT_PORT = 11451
SUPPORTED = [("kONNXRUNTIME", "kCPU"), ("kONNXRUNTIME", "kDML"), ("kONNXRUNTIME", "kCUDA"), ("kONNXRUNTIME", "kTensorRT")]
# Thresholds by entry point.
HTTP_THRESHOLD, VIDEO_THRESHOLD, OCR_THRESHOLD, NMS_THRESHOLD = 0.125, 0.225, 0.5, 0.3
