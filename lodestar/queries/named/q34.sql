SELECT c_city, s_city, d_year, sum(lo_revenue) AS revenue
FROM customer, lineorder, supplier, ddate
WHERE lo_custkey = c_custkey
  AND lo_suppkey = s_suppkey
  AND lo_orderdate = d_datekey
  AND c_city IN ('NATION_2 5', 'NATION_6 5')
  AND s_city IN ('NATION_2 5', 'NATION_6 5')
  AND d_yearmonth = 'Dec2000'
GROUP BY c_city, s_city, d_year
ORDER BY d_year, revenue DESC
