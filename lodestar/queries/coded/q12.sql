SELECT sum(lo_extendedprice * lo_discount) AS revenue
FROM lineorder
WHERE lo_orderdate BETWEEN 19970101 AND 19970131
  AND lo_discount BETWEEN 4 AND 6
  AND lo_quantity BETWEEN 26 AND 35
