"""The catalogue of forcing datasets: names, file masks, frequencies, time references, variables and their unit transforms."""

from __future__ import annotations

import ast
import math
import operator
import re
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gyre.functions import geometry
from gyre.operators import grids, locate
from gyre.operators.fields import nan_to_zero, renumbered, unit_transform

#: Grids that sessions have made, by application, dataset, folder, box, halo and mask: written tables, so what is kept here are their plans.
_GRIDS: dict[tuple, DataFrame] = {}

#: Densities of water and snow in kg m-3, and hours between forecast steps.
CONSTANTS = {"rhow": 1025.0, "rhos": 330.0, "res_h": 6.0}
# Name | file mask | frequency | interpolation | masked | time=variable[factor, hours added]; reference; days averaged | east-west vectors | model=source[a, b, unit]
TABLE = """
asr_nodes | asr30km.comb.2D.%Y%m.nc | monthly | FromGridToMesh Bilinear | false | time=Time[1.,0.,hours]; ref 1901-01-01; avg 0. | false | u=U10M[1.,0.,m/s]; v=V10M[1.,0.,m/s]
asr_elements | asr30km.comb.2D.%Y%m.nc | monthly | FromGridToMesh Bilinear | false | time=Time[1.,0.,hours]; ref 1901-01-01; avg 0. | - | tair=T2M[1.,-273.15,C]; mixrat=Q2M[1.,0.,]; mslp=PSFC[1.,0.,Pa]; Qsw_in=SWDNB[1.,0.,W/m^2]; Qlw_in=LWDNB[1.,0.,W/m^2]; snowfr=SR[1.,0.,]; precip=RAINNC[rhow/1000./(3.*3600),0.,kg/m^2/s]
generic_ps_atm_nodes | generic_ps_atm_%Y%m%d.nc | daily | FromGridToMesh Bilinear | false | time=time[24.,0.,hours]; ref 1900-01-01; avg 0. | false | u=x_wind_10m[1.,0.,m/s]; v=y_wind_10m[1.,0.,m/s]
generic_ps_atm_elements | generic_ps_atm_%Y%m%d.nc | daily | FromGridToMesh Bilinear | false | time=time[24.,0.,hours]; ref 1900-01-01; avg 0. | - | tair=air_temperature_2m[1.,-273.15,C]; dair=dew_point_temperature_2m[1.,-273.15,C]; mslp=atm_pressure[1.,0.,Pa]; Qsw_in=instantaneous_downwelling_shortwave_radiation[1.,0.,W/m^2]; Qlw_in=instantaneous_downwelling_longwave_radiation[1.,0.,W/m^2]; snowfall=snowfall_rate[1.,0.,kg/m^2/s]; precip=total_precipitation_rate[1.,0.,kg/m^2/s]
ecmwf_nrt_arome_nodes | ecmwf_nrt_arome_blended_%Y%m%d.nc | daily | FromGridToMesh Bilinear | false | time=time[1./3600.,0.,hours]; ref 1970-01-01; avg 0. | false | u=x_wind_10m[1.,0.,m/s]; v=y_wind_10m[1.,0.,m/s]
ecmwf_nrt_arome_elements | ecmwf_nrt_arome_blended_%Y%m%d.nc | daily | FromGridToMesh Bilinear | false | time=time[1./3600.,0.,hours]; ref 1970-01-01; avg 0. | - | tair=air_temperature_2m[1.,-273.15,C]; sphuma=specific_humidity_2m[1.,0.,]; mslp=air_pressure_at_sea_level[1.,0.,Pa]; Qsw_in=integral_of_surface_downwelling_shortwave_flux_in_air_wrt_time[1./3600.,0.,W/m^2]; Qlw_in=integral_of_surface_downwelling_longwave_flux_in_air_wrt_time[1./3600.,0.,W/m^2]; snowfall=integral_of_snowfall_amount_wrt_time[1./3600.,0.,kg/m^2/s]; precip=precipitation_amount_acc[1./3600.,0.,kg/m^2/s]
ecmwf_nrt_arome_ensemble_nodes | ecmwf_nrt_arome_blended_ensemble_%Y%m%d.nc | daily | FromGridToMesh Bilinear | false | time=time[1./3600.,0.,hours]; ref 1970-01-01; avg 0. | false | u=x_wind_10m[1.,0.,m/s]; v=y_wind_10m[1.,0.,m/s]
ecmwf_nrt_arome_ensemble_elements | ecmwf_nrt_arome_blended_ensemble_%Y%m%d.nc | daily | FromGridToMesh Bilinear | false | time=time[1./3600.,0.,hours]; ref 1970-01-01; avg 0. | - | tair=air_temperature_2m[1.,-273.15,C]; sphuma=specific_humidity_2m[1.,0.,]; mslp=air_pressure_at_sea_level[1.,0.,Pa]; Qsw_in=integral_of_surface_downwelling_shortwave_flux_in_air_wrt_time[1./(3*3600.),0.,W/m^2]; Qlw_in=integral_of_surface_downwelling_longwave_flux_in_air_wrt_time[1./(3*3600.),0.,W/m^2]; snowfall=integral_of_snowfall_amount_wrt_time[1./(3*3600.),0.,kg/m^2/s]; precip=precipitation_amount_acc[1./(3*3600.),0.,kg/m^2/s]
topaz4r_nodes | %Y/topaz_rean_%Y%m.nc | monthly | FromMeshToMesh2dx | true | time=time[1.,12.,hours]; ref 1950-01-01; avg 1. | false | u=vxo[1.,0.,m/s]; v=vyo[1.,0.,m/s]; ssh=zos[1.,0.,m/s]
topaz4r_elements | %Y/topaz_rean_%Y%m.nc | monthly | FromMeshToMesh2dx | true | time=time[1.,12.,hours]; ref 1950-01-01; avg 1. | - | sst=thetao[1.,0.,deg celsius]; sss=so[1.,0.,]; mld=mlotst[1.,0.,m]
glorys12_nodes | GLORYS12V1_%Y_30m.nc | yearly | FromGridToMesh Bilinear in lat/lon | false | time=time[1.,0.,hours]; ref 1950-01-01; avg 1. | true | u=uo[1.,0.,m/s]; v=vo[1.,0.,m/s]; ssh=zos[1.,0.,m]
glorys12_elements | GLORYS12V1_%Y_3m.nc | yearly | FromGridToMesh Bilinear in lat/lon | false | time=time[1.,0.,hours]; ref 1950-01-01; avg 1. | - | sst=thetao[1.,0.,C]; sss=so[1.,0.,]; mld=mlotst[1.,0.,m]; conc=siconc[1.,0.,m]; thick=sithick[1.,0.,m]
ocean_cpl_nodes | ${EXCHANGE_GRID} | coupled | FromMeshToMeshQuick | true | time=time[24.,0.,hours]; ref 1979-01-01; avg 1. | false | u=I_Uocn[1.,0.,m/s]; v=I_Vocn[1.,0.,m/s]; ssh=I_SSH[1.,0.,m]; mask=mask[1.,0.,]; theta=ptheta[1.,0.,radians]
ocean_cpl_elements | ${EXCHANGE_GRID} | coupled | ConservativeRemapping | true | time=time[24.,0.,hours]; ref 1979-01-01; avg 1. | - | sst=I_SST[1.,0.,deg celsius]; sss=I_SSS[1.,0.,]; qsrml=I_FrcQsr[1.,0.,m]; mld=I_MLD[1.,0.,m]; mask=mask[1.,0.,]
wave_cpl_nodes | ${EXCHANGE_GRID} | coupled | FromMeshToMeshQuick | true | time=time[24.,0.,hours]; ref 1979-01-01; avg 0. | true | tau_wi_x=I_tauwix[rhow,0.,Pa]; tau_wi_y=I_tauwiy[rhow,0.,Pa]; mask=mask[1.,0.,]; theta=ptheta[1.,0.,radians]
wave_cpl_elements | ${EXCHANGE_GRID} | coupled | ConservativeRemapping | true | time=time[24.,0.,hours]; ref 1979-01-01; avg 0. | - | wlbk=I_wlbk[2.,0.,m]; mask=mask[1.,0.,]
nesting_ocean_elements | nesting_${SETUP}_%Y%m%d.nc | daily | FromMeshToMesh2dx | true | time=time[24.,0.,hours]; ref 1900-01-01; avg 0 | - | sst=sea_surface_temperature[1.,0.,deg celsius]; sss=sea_surface_salinity[1.,0.,deg celsius]
nesting_ice_elements | nesting_${SETUP}_%Y%m%d.nc | daily | FromMeshToMesh2dx | true | time=time[24.,0.,hours]; ref 1900-01-01; avg 0 | - | sit=sea_ice_thickness[1.,0.,m]; sic=sea_ice_area_fraction[1.,0.,1]; snt=surface_snow_thickness[1.,0.,m]; sit_young=young_ice_thickness[1.,0.,m]; sic_young=young_ice_area_fraction[1.,0.,1]; snt_young=surface_snow_thickness_on_young_ice[1.,0.,m]
nesting_dynamics_elements | nesting_${SETUP}_%Y%m%d.nc | daily | FromMeshToMesh2dx | true | time=time[24.,0.,hours]; ref 1900-01-01; avg 0 | - | sigma1=stress_tensor_first_component[1.,0.,1]; sigma2=stress_tensor_second_component[1.,0.,1]; sigma3=stress_tensor_third_component[1.,0.,1]; damage=sea_ice_damage[1.,0.,1]; ridge_ratio=ridge_ratio[1.,0.,1]
nesting_nodes | nesting_${SETUP}_%Y%m%d.nc | daily | FromMeshToMesh2dx | true | time=time[24.,0.,hours]; ref 1900-01-01; avg 0 | - | siu=sea_ice_x_velocity[1.,0.,m s-1]; siv=sea_ice_y_velocity[1.,0.,m s-1]
nesting_distance_nodes | nesting_grid_${SETUP}.nc | constant | FromMeshToMesh2dx | true | time=?; ref -; avg 0 | - | nesting_distance=nesting_distance[1.,0.,m]
nesting_distance_elements | nesting_grid_${SETUP}.nc | constant | FromMeshToMesh2dx | true | time=?; ref -; avg 0 | - | nesting_distance=nesting_distance[1.,0.,m]
topaz4_nrt_nodes | topaz_nrt_%Y%m%d.nc | daily | FromGridToMesh Bilinear | true | time=time[1.,0.,hours]; ref 1950-01-01; avg 1. | false | u=u[1.,0.,m/s]; v=v[1.,0.,m/s]; ssh=ssh[1.,0.,m/s]
topaz4_nrt_elements | topaz_nrt_%Y%m%d.nc | daily | FromGridToMesh Bilinear | true | time=time[1.,0.,hours]; ref 1950-01-01; avg 1. | - | sst=temperature[1.,0.,deg celsius]; sss=salinity[1.,0.,]; mld=mlp[1.,0.,m]; conc=fice[1.,0.,]; thick=hice[1.,0.,m]; snow_thick=hsnow[1.,0.,m]
topaz5_nrt_nodes | topaz_nrt_%Y%m%d.nc | daily | FromGridToMesh Bilinear | true | time=time[1./3600.,0.,hours]; ref 1970-01-01; avg 1. | false | u=vxo[1.,0.,m/s]; v=vyo[1.,0.,m/s]; ssh=zos[1.,0.,m]
topaz5_nrt_elements | topaz_nrt_%Y%m%d.nc | daily | FromGridToMesh Bilinear | true | time=time[1./3600.,0.,hours]; ref 1970-01-01; avg 1. | - | sst=thetao[1.,0.,deg celsius]; sss=so[1.,0.,]; mld=mlotst[1.,0.,m]; conc=siconc[1.,0.,]; thick=sithick[1.,0.,m]; snow_thick=sisnthick[1.,0.,m]
ice_topaz4r_elements | %Y/topaz_rean_%Y%m.nc | monthly | FromMeshToMesh2dx | true | time=time[1.,12.,hours]; ref 1950-01-01; avg 1. | - | conc=siconc[1.,0.,]; thick=sithick[1.,0.,m]; snow_thick=sisnthick[1.,0.,m]
ice_piomas_elements | PIOMAS_%Y.nc | yearly | FromMeshToMesh2dx | true | time=time[1.,0.,hours]; ref 1950-01-01; avg 365./12 | - | conc=area[1.,0.,]; thick=heff[1.,0.,m]; snow_thick=snow[1.,1/rhos,m]
ocean_currents_nodes | current_%Y.nc | yearly | FromMeshToMesh2dx | true | time=time[1.,0.,hours]; ref 1950-01-01; avg 365./12 | false | u=U[1.,0.,m/s]; v=V[1.,0.,m/s]; ssh=SSH[1.,0.,m]
ice_amsre_elements | asi-n6250-%Y%m%d-v5i.nc | daily | FromMeshToMesh2dx | true | time=time[1./3600,12.,hours]; ref 2002-01-01; avg 1. | - | conc=icecon[0.01,0.,]
ice_osisaf_elements | ice_conc_nh_polstere-100_multi_%Y%m%d1200.nc | nearest_daily | FromMeshToMesh2dx | true | time=time[1./3600,12.,hours]; ref 1978-01-01; avg 1. | - | conc=ice_conc[0.01,0.,]; confidence=confidence_level[1.,0.,]
ice_osisaf_type_elements | ice_type_nh_polstere-100_multi_%Y%m%d1200.nc | nearest_daily | FromMeshToMesh2dx | true | time=time[1./3600,12.,hours]; ref 1978-01-01; avg 1. | - | type=ice_type[1.,0.,]
ice_smos_elements | SMOS_Icethickness_v3.1_north_%Y%m%d.nc | nearest_daily | FromMeshToMesh2dx | true | time=time[1.,12.,hours]; ref 2010-01-01; avg 1. | - | thickness=sea_ice_thickness[1.,0.,]
ice_cs2_smos_elements | cs2_smos_ice_thickness_%Y%m%d.nc | nearest_daily | FromMeshToMesh2dx | true | time=?; ref -; avg 1. | - | conc=sea_ice_concentration[0.01,0.,]; thickness=analysis_sea_ice_thickness[1.,0.,m]
ice_amsr2_elements | Arc_%Y%m%d_res3.125_pyres.nc | nearest_daily | FromMeshToMesh2dx | true | time=time[24.,12.,hours]; ref 0001-01-01; avg 1. | - | conc=sea_ice_concentration[0.01,0.,]; mask=land[1.,0.,]
ice_nic_weekly_elements | NIC_weekly_%Y%m%d_res3.125_pyres.nc | nearest_daily | FromMeshToMesh2dx | true | time=time[24.,12.,hours]; ref 0001-01-01; avg 1. | - | conc=sea_ice_concentration[0.01,0.,]; mask=land[1.,0.,]
ice_nic_elements | NIC_%Y%m%d_res3.125_pyres.nc | nearest_daily | FromMeshToMesh2dx | true | time=time[24.,12.,hours]; ref 0001-01-01; avg 1. | - | conc=sea_ice_concentration[0.01,0.,]; mask=land[1.,0.,]
ice_icesat_elements | icesat_icethk_ON06_filled.nc | constant | FromMeshToMesh2dx | false | time=?; ref -; avg 0. | - | thickness=Th[0.01,0.,]
ice_cice_elements | CICE_%Y%m.nc | monthly | FromMeshToMesh2dx | true | time=time[1.,0.,hours]; ref 1958-01-01; avg 1. | - | conc=aice_d[1.,0.,]; thick=hi_d[1.,0.,m]; snow_thick=hs_d[1.,0.,m]
ice_nemo_elements | NEMO_icemod.nc | constant | FromMeshToMesh2dx | true | time=?; ref -; avg 0. | - | thickness=hicif[1.,0.,m]; concentration=frld[-1.,1.,]; snow=hsnif[1.,0.,m]; mask=tmaskutil[1.,0.,m]
dist2coast_elements | dist2coast_4deg.nc | constant | FromGridToMesh Bilinear in lat/lon cyclic-x | false | time=?; ref -; avg 0. | - | dist=dist[1000.,0.,m]
etopo_elements | ${BATHYMETRY} | constant | FromGridToMesh Bilinear in lat/lon cyclic-x | false | time=?; ref -; avg 0. | - | z=z[-1.,0.,m]
cfsr_elements | cfsr.6h.%Y%m.nc | monthly | FromGridToMesh Bilinear in lat/lon | false | time=time0[1.,0.,hours]; ref 1901-01-01; avg 0. | - | tair=TMP_L103[1.,-273.15,C]; sphuma=SPF_H_L103[1.,0.,kg/kg]; mslp=PRES_L1[1.,0.,Pa]; Qsw_in=DSWRF_L1_Avg_1[1.,0.,W/m^2]; Qlw_in=DLWRF_L1_Avg_1[1.,0.,W/m^2]; precip=A_PCP_L1_Accum_1[1./(6.*3600),0.,kg/m^2/s]; snowfr=CSNOW_L1_Avg_1[1.,0.,]
cfsr_nodes | cfsr.6h.%Y%m.nc | monthly | FromGridToMesh Bilinear in lat/lon | false | time=time0[1.,0.,hours]; ref 1901-01-01; avg 0. | true | u=U_GRD_L103[1.,0.,m/s]; v=V_GRD_L103[1.,0.,m/s]
cfsr_nodes_hi | cfsr_h.sh.%Y%m.nc | monthly | FromGridToMesh Bilinear in lat/lon | false | time=time0[1.,0.,hours]; ref 1901-01-01; avg 0. | true | u=U_GRD_L103[1.,0.,m/s]; v=V_GRD_L103[1.,0.,m/s]
ERA5_elements | ERA5_${VARSTRING}_y%Y.nc | yearly | FromGridToMesh Bilinear in lat/lon cyclic-x | false | time=time[1.,0.,hours]; ref 1900-01-01; avg 0. | - | tair=t2m[1.,-273.15,C]; dair=d2m[1.,-273.15,C]; mslp=msl[1.,0.,Pa]; Qsw_in=msdwswrf[1.,0.,W/m^2]; Qlw_in=msdwlwrf[1.,0.,W/m^2]; precip=mtpr[1.,0.,kg/m^2/s]; snowfall=msr[1.,0.,kg/m^2/s]
ERA5_nodes | ERA5_${VARSTRING}_y%Y.nc | yearly | FromGridToMesh Bilinear in lat/lon cyclic-x | false | time=time[1.,0.,hours]; ref 1900-01-01; avg 0. | true | u=u10[1.,0.,m/s]; v=v10[1.,0.,m/s]
ecmwf_nrt_elements | ecmwf_nrt_%Y%m%d.nc | daily | FromGridToMesh Bilinear in lat/lon cyclic-x | false | time=time[1.,0.,hours]; ref 1950-01-01; avg 0. | - | tair=2T[1.,-273.15,C]; dair=2D[1.,-273.15,C]; mslp=MSL[1.,0.,Pa]; Qsw_in=SSRD[1./(res_h*3600),0.,W/m^2]; Qlw_in=STRD[1./(res_h*3600),0.,W/m^2]; tcc=TCC[1.,0.,]; precip=TP[rhow/(res_h*3600),0.,kg/m^2/s]
ecmwf_nrt_nodes | ecmwf_nrt_%Y%m%d.nc | daily | FromGridToMesh Bilinear in lat/lon cyclic-x | false | time=time[1.,0.,hours]; ref 1950-01-01; avg 0. | true | u=10U[1.,0.,m/s]; v=10V[1.,0.,m/s]
ww3a_elements | SWARP_WW3_ARCTIC-12K_%Y%m%d.nc | daily | FromMeshToMesh2dx | true | time=time[24.,0.,hours]; ref 1990-01-01; avg 0. | true | SWH=hs[1.,0.,m]; FP=fp[1.,0.,/s]; MWDx=dir[1.,0.,degree]; MWDy=dir[1.,0.,degree]; FICE=ice[1.,0.,]
erai_waves_1deg_elements | erai_waves_1deg_%Y.nc | yearly | FromGridToMesh Bilinear in lat/lon cyclic-x | false | time=time[1.,0.,hours]; ref 1900-01-01; avg 0. | true | SWH=swh[1.,0.,m]; MWP=mwp[1.,0.,s]; MWDx=mwd[1.,0.,degree]; MWDy=mwd[1.,0.,degree]
"""


@dataclass(frozen=True)
class Variable:
    name: str
    source: str
    a: float
    b: float
    unit: str

    def column(self, scale: float = 1.0, offset: float = 0.0) -> Column:
        """The model's value of the stored column; NaN becomes 0 but in wave directions."""
        out = unit_transform(F.col(f"`{self.source}`"), scale, offset, self.a, self.b)
        return (out if self.name.startswith("MWD") else nan_to_zero(out)).alias(self.name)


@dataclass(frozen=True)
class Dataset:
    name: str
    mask: str
    frequency: str
    method: str
    masked: bool
    time: str | None
    time_a: float
    time_b: float
    reference: date | None
    averaged: float
    east_west: bool | None
    variables: tuple[Variable, ...]

    def path(self, day: date, root: str = "", **parts: str) -> str:
        """The file of a day: %Y, %m, %d and ${NAME} are filled in."""
        out = self.mask.replace("%Y", f"{day.year:04d}").replace("%m", f"{day.month:02d}").replace("%d", f"{day.day:02d}")
        out = re.sub(r"\$\{(\w+)\}", lambda m: parts[m[1].lower()], out)
        return f"{root.rstrip('/')}/{out}" if root else out

    def path_of(self, day: Column, root: str = "", **parts: str) -> Column:
        """``path`` of a column of days."""
        out = F.lit(re.sub(r"\$\{(\w+)\}", lambda m: parts[m[1].lower()], self.mask))
        for mark, value in (("%Y", F.lpad(F.year(day).cast("string"), 4, "0")), ("%m", F.lpad(F.month(day).cast("string"), 2, "0")), ("%d", F.lpad(F.day(day).cast("string"), 2, "0"))):
            out = F.replace(out, F.lit(mark), value)
        return F.concat(F.lit(root.rstrip("/") + "/"), out) if root else out

    def days(self, raw: Column) -> Column:
        """Decimal days since 1900-01-01 of the stored time."""
        if self.reference is None:
            raise ValueError(f"{self.name} has no time")
        return (raw * self.time_a + self.time_b) / 24 + (self.reference - date(1900, 1, 1)).days

    def days_around(self, day: date, jumps: tuple[int, ...] = (-1, 0, 1)) -> list[date]:
        """The day moved by whole files: days, months or years by the files' frequency; a constant has one file."""

        def moved(k: int) -> date:
            if self.frequency == "yearly":
                return date(day.year + k, 1, 1)
            if self.frequency == "monthly":
                m = day.year * 12 + day.month - 1 + k
                return date(m // 12, m % 12 + 1, 1)
            return day + timedelta(days=k)

        return [day] if self.frequency == "constant" else [moved(k) for k in jumps]

    def opened(self, spark: SparkSession, day: date, keep: list[str], root: str = "", jumps: tuple[int, ...] = (-1, 0, 1), **parts: str) -> DataFrame:
        """Rows of the files (staged as Parquet) of a day and of its neighbours by ``jumps``, so that a time near a file's end has its steps on both sides.

        keep and the model's variables, and, where the data have a time, ``days`` (decimal, since 1900-01-01).  The
        day's own file must be there; neighbours may be missing.
        """
        out = None
        for k, d in enumerate(dict.fromkeys(self.path(x, root, **parts) for x in self.days_around(day, jumps))):
            try:
                rows = spark.read.parquet(d)
            except AnalysisException:
                if d == self.path(day, root, **parts):
                    raise
                continue
            timed = [] if self.time is None or self.reference is None else [self.days(F.col(self.time)).alias("days")]
            own = rows.select(*keep, *timed, *[v.column() for v in self.variables if v.source in rows.columns])
            out = own if out is None else out.unionByName(own, allowMissingColumns=True)
        return out

    def file_day(self, t: float) -> date:
        """The day whose file holds a time (decimal days since 1900-01-01): half the averaging period earlier, but for data of one file or of the nearest day."""
        whole = self.frequency in ("constant", "nearest_daily")
        return date(1900, 1, 1) + timedelta(days=math.floor(t if whole else t - self.averaged / 2))

    def steps(self, rows: DataFrame, t: float) -> DataFrame:
        """rows (days, ...) of the last step at or before a time and of the next one (means count at the middle of their period); all rows where the data have no time."""
        if "days" not in rows.columns:
            return rows
        if self.frequency == "nearest_daily":
            return rows.where(F.floor("days") == math.floor(t))
        at = t - self.averaged / 2
        ends = rows.agg(F.max(F.when(F.col("days") <= at, F.col("days"))), F.min(F.when(F.col("days") > at, F.col("days")))).first()
        return rows.where(F.col("days").isin([e for e in ends if e is not None]))

    def grid_of(self, rows: DataFrame, box: tuple[float, float, float, float] | None, halo: int, wet: str | None, root: str) -> DataFrame:
        """(cell, i, j, x, y): cells of the index window of rows (i, j, x, y, ...) around a box (x0, x1, y0, y1) and ``halo`` more on each side, wet ones only where a mask is named, numbered from 0 by row and column.

        Kept for each dataset, box and mask of a session: a grid is made once.
        """
        spark = rows.sparkSession
        key = (spark.sparkContext.applicationId, self.name, root, box, halo, wet)
        if key not in _GRIDS:
            cells = rows.groupBy("i", "j").agg(*[F.first(c).alias(c) for c in ("x", "y")], *([F.max(F.col(wet).isNotNull()).alias("_wet")] if wet else []))
            if box:
                inside = F.col("x").between(box[0], box[1]) & F.col("y").between(box[2], box[3])
                a = cells.where(inside).agg(*[f(c) for c in "ij" for f in (F.min, F.max)]).first()
                cells = cells.where(F.lit(False)) if a[0] is None else cells.where(F.col("i").between(a[0] - halo, a[1] + halo) & F.col("j").between(a[2] - halo, a[3] + halo))
            cells = cells.where("_wet") if wet else cells
            _GRIDS[key] = renumbered(cells, ["j", "i"], into="cell").select("cell", "i", "j", "x", "y")
        return _GRIDS[key]

    def loaded(self, spark: SparkSession, t: float, root: str = "", box: tuple[float, float, float, float] | None = None, halo: int = 1, wet: str | None = None, variables: list[str] | None = None, **parts: str) -> DataFrame:
        """(cell, i, j, x, y, days, variables): the steps around a time (decimal days since 1900-01-01) from the files that hold it, decoded, cropped, numbered.

        Files are staged as Parquet with i, j, x, y, the time and the stored variables; a cell is wet where the stored ``wet`` isn't null.
        """
        keep = ["i", "j", "x", "y"]
        mask = [wet] if wet else []
        rows = self.opened(spark, self.file_day(t), [*keep, *mask], root, **parts)
        now = self.steps(rows, t)
        grid = self.grid_of(now, box, halo, wet, root)
        names = [v.name for v in self.variables if v.name in rows.columns and (variables is None or v.name in variables)]
        timed = ["days"] if "days" in rows.columns else []
        return grid.join(now.select("i", "j", *timed, *names), ["i", "j"]).select("cell", *keep, *timed, *names)

    def is_cyclic(self) -> bool:
        return "cyclic" in self.method

    def sampled(self, points: DataFrame, grid: DataFrame, start: tuple[float, float], step: float, shape: tuple[int, int], variable: str) -> DataFrame:
        """points (px, py) with the variable of a regular grid (i, j, variable) by the dataset's own method, bilinear, with the first column once more where the grid closes around the globe."""
        if not self.method.startswith("FromGridToMesh"):
            raise ValueError(f"{self.name} is on a mesh: use operators.locate or operators.remap")
        if self.is_cyclic():
            grid, shape = grids.cyclic(grid, shape[0]), (shape[0] + 1, shape[1])
        at = locate.cell_values(points, grid, start, step, shape, variable)
        return at.withColumn(variable, geometry.bilinear(*map(F.col, ("dx", "dy", "v00", "v10", "v01", "v11")))).select(*points.columns, variable)

    def select(self, rows: DataFrame, keep: list[str]) -> DataFrame:
        """keep and the model's variables; those that the files lack are left out."""
        return rows.select(*keep, *[v.column() for v in self.variables if v.source in rows.columns])


def number(text: str) -> float:
    """A product, quotient or negation of numbers and known constants."""
    ops = {ast.Mult: operator.mul, ast.Div: operator.truediv, ast.Sub: operator.sub, ast.Add: operator.add}

    def value(n: ast.AST) -> float:
        if isinstance(n, ast.Constant):
            return float(n.value)
        if isinstance(n, ast.Name):
            return CONSTANTS[n.id]
        if isinstance(n, ast.UnaryOp):
            return -value(n.operand)
        return ops[type(n.op)](value(n.left), value(n.right))

    return value(ast.parse(text.strip(), mode="eval").body)


def parsed(line: str) -> Dataset:
    name, mask, frequency, method, masked, time, ew, variables = (x.strip() for x in line.split(" | "))
    t = re.match(r"time=(\w+)\[([^,]*),([^,]*),\w+\]; ref (\S+); avg (.*)", time)
    out = []
    for v in variables.split("; "):
        m = re.fullmatch(r"(\w+)=(\w+)\[([^,]*),([^,]*),(.*)\]", v)
        out.append(Variable(m[1], m[2], number(m[3]), number(m[4]), m[5]))
    avg = number(time.rpartition("avg ")[2])
    ref = date.fromisoformat(t[4]) if t and t[4] != "-" else None
    return Dataset(name, mask, frequency, " ".join(method.split()), masked == "true", t and t[1], number(t[2]) if t else 1.0, number(t[3]) if t else 0.0, ref, avg, {"true": True, "false": False}.get(ew), tuple(out))


CATALOGUE = {d.name: d for d in map(parsed, TABLE.strip().splitlines())}


def dataset(name: str) -> Dataset:
    if name not in CATALOGUE:
        raise ValueError(f"no such dataset: {name}")
    return CATALOGUE[name]


def as_table(spark: SparkSession) -> DataFrame:
    """(dataset, frequency, method, variable, source, a, b, unit) of the whole catalogue."""
    rows = [(d.name, d.frequency, d.method, v.name, v.source, v.a, v.b, v.unit) for d in CATALOGUE.values() for v in d.variables]
    return spark.createDataFrame(rows, "dataset string, frequency string, method string, variable string, source string, a double, b double, unit string")
