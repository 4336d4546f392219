"""Explicit schemas, as DDL. Codes have at most 52 bits, so BIGINT holds them."""

IMAGE = "image_id string, width int, height int, stride int, data binary"
DETECTION = "family string, id int, hamming int, decision_margin float, center array<double>, corners array<array<double>>"
POSE = "rotation array<double>, translation array<double>, error double, alt_rotation array<double>, alt_translation array<double>, alt_error double"
TRUTH = "image_id string, family string, id int, corners array<array<double>>, center array<double>, rotation array<double>, translation array<double>, params struct<tagsize:double,fx:double,fy:double,cx:double,cy:double>"
FAMILY = "name string, min_hamming int, min_complexity int, layout string, grid_size int, nbits int, border_start int, border_width int, reversed_border boolean"
