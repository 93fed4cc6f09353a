"""Fixed values that decide results: name keywords with their module, name patterns with their headers.

Plain lists in the order in which they are tried; shapes and lookups are derived in
:mod:`docatlas.dims`."""

# Keyword, module.  The longest keyword in a name wins, then the first.
KEYWORDS = """
nt ntdll.dll
zw ntdll.dll
rtl ntdll.dll
allocatevirtualmemory ntdll.dll
freevirtualmemory ntdll.dll
createprocess kernel32.dll
createprocessa kernel32.dll
createprocessw kernel32.dll
openprocess kernel32.dll
terminateprocess kernel32.dll
getprocessid kernel32.dll
getcurrentprocess kernel32.dll
getcurrentprocessid kernel32.dll
getprocessversion kernel32.dll
getprocesstimes kernel32.dll
getprocessiofounters kernel32.dll
getprocessworkingsetsize kernel32.dll
setprocessworkingsetsize kernel32.dll
getprocessaffinitymask kernel32.dll
setprocessaffinitymask kernel32.dll
getprocesspriorityboost kernel32.dll
setprocesspriorityboost kernel32.dll
getprocesspriorityclass kernel32.dll
setprocesspriorityclass kernel32.dll
exitprocess kernel32.dll
getexitcodeprocess kernel32.dll
getthreadid kernel32.dll
createthread kernel32.dll
createremotethread kernel32.dll
createremotethreadex kernel32.dll
openthread kernel32.dll
suspendthread kernel32.dll
resumethread kernel32.dll
terminatethread kernel32.dll
getcurrentthread kernel32.dll
getcurrentthreadid kernel32.dll
getthreadtimes kernel32.dll
getthreadpriority kernel32.dll
setthreadpriority kernel32.dll
getthreadpriorityboost kernel32.dll
setthreadpriorityboost kernel32.dll
getthreadaffinitymask kernel32.dll
setthreadaffinitymask kernel32.dll
getthreadcontext kernel32.dll
setthreadcontext kernel32.dll
exitthread kernel32.dll
getexitcodethread kernel32.dll
waitforsingleobject kernel32.dll
waitforsingleobjectex kernel32.dll
waitformultipleobjects kernel32.dll
waitformultipleobjectsex kernel32.dll
signalObjectandwait kernel32.dll
tlsalloc kernel32.dll
tlsfree kernel32.dll
tlsgetvalue kernel32.dll
tlssetvalue kernel32.dll
virtualalloc kernel32.dll
virtualallocex kernel32.dll
virtualallocexnuma kernel32.dll
virtualalloc2 kernel32.dll
virtualfree kernel32.dll
virtualfreeex kernel32.dll
virtualprotect kernel32.dll
virtualprotectex kernel32.dll
virtualquery kernel32.dll
virtualqueryex kernel32.dll
virtuallock kernel32.dll
virtualunlock kernel32.dll
readprocessmemory kernel32.dll
writeprocessmemory kernel32.dll
createfilemapping kernel32.dll
createfilemappinga kernel32.dll
createfilemappingw kernel32.dll
createfilemappingnuma kernel32.dll
mapviewoffile kernel32.dll
mapviewoffileex kernel32.dll
mapviewoffilenuma kernel32.dll
unmapviewoffile kernel32.dll
flushviewoffile kernel32.dll
heapcreate kernel32.dll
heapalloc kernel32.dll
heapfree kernel32.dll
heapdestroy kernel32.dll
heaplock kernel32.dll
heapunlock kernel32.dll
heapvalidate kernel32.dll
heapsize kernel32.dll
heapwalk kernel32.dll
getprocessheap kernel32.dll
getprocessheaps kernel32.dll
heapsetinformation kernel32.dll
heapqueryinformation kernel32.dll
globalalloc kernel32.dll
globalrealloc kernel32.dll
globalfree kernel32.dll
globallock kernel32.dll
globalunlock kernel32.dll
globalsize kernel32.dll
globalflags kernel32.dll
globalhandle kernel32.dll
localalloc kernel32.dll
localrealloc kernel32.dll
localfree kernel32.dll
locallock kernel32.dll
localunlock kernel32.dll
localsize kernel32.dll
localflags kernel32.dll
localhandle kernel32.dll
createfile kernel32.dll
createfilea kernel32.dll
createfilew kernel32.dll
createfile2 kernel32.dll
readfile kernel32.dll
writefile kernel32.dll
readfileex kernel32.dll
writefileex kernel32.dll
deletefile kernel32.dll
deletefilea kernel32.dll
deletefilew kernel32.dll
copyfile kernel32.dll
copyfilea kernel32.dll
copyfilew kernel32.dll
copyfileex kernel32.dll
copyfileexa kernel32.dll
copyfileexw kernel32.dll
movefile kernel32.dll
movefilea kernel32.dll
movefilew kernel32.dll
movefileex kernel32.dll
movefileexa kernel32.dll
movefileexw kernel32.dll
findfirstfile kernel32.dll
findfirstfilea kernel32.dll
findfirstfilew kernel32.dll
findfirstfileex kernel32.dll
findfirstfileexa kernel32.dll
findfirstfileexw kernel32.dll
findnextfile kernel32.dll
findnextfilea kernel32.dll
findnextfilew kernel32.dll
findclose kernel32.dll
getfileattributes kernel32.dll
getfileattributesa kernel32.dll
getfileattributesw kernel32.dll
getfileattributesex kernel32.dll
getfileattributesexa kernel32.dll
getfileattributesexw kernel32.dll
setfileattributes kernel32.dll
setfileattributesa kernel32.dll
setfileattributesw kernel32.dll
getfiletime kernel32.dll
setfiletime kernel32.dll
getfilesize kernel32.dll
getfilesizeex kernel32.dll
setfilepointer kernel32.dll
setfilepointerex kernel32.dll
getfullpathname kernel32.dll
getfullpathnamea kernel32.dll
getfullpathnamew kernel32.dll
getcurrentdirectory kernel32.dll
getcurrentdirectorya kernel32.dll
getcurrentdirectoryw kernel32.dll
setcurrentdirectory kernel32.dll
setcurrentdirectorya kernel32.dll
setcurrentdirectoryw kernel32.dll
createdirectory kernel32.dll
createdirectorya kernel32.dll
createdirectoryw kernel32.dll
removedirectory kernel32.dll
removedirectorya kernel32.dll
removedirectoryw kernel32.dll
getlogicaldrives kernel32.dll
getlogicaldrivesrings kernel32.dll
getdrivetypea kernel32.dll
getdrivetypew kernel32.dll
getdiskfreespace kernel32.dll
getdiskfreespacea kernel32.dll
getdiskfreespacew kernel32.dll
getdiskfreespaceex kernel32.dll
getdiskfreespaceexa kernel32.dll
getdiskfreespaceexw kernel32.dll
loadlibrary kernel32.dll
freelibrary kernel32.dll
getprocaddress kernel32.dll
getmodulehandle kernel32.dll
getmodulefilename kernel32.dll
timezone kernel32.dll
dynamic kernel32.dll
time kernel32.dll
getlasterror kernel32.dll
setlasterror kernel32.dll
formatmessage kernel32.dll
sleep kernel32.dll
getcommandline kernel32.dll
getcomputername kernel32.dll
getenvironmentvariable kernel32.dll
setenvironmentvariable kernel32.dll
adjusttokenprivileges advapi32.dll
duplicatetoken advapi32.dll
openprocesstoken advapi32.dll
openthreadtoken advapi32.dll
lookupprivilegevalue advapi32.dll
impersonateloggedonuser advapi32.dll
reverttoself advapi32.dll
logonuser advapi32.dll
createprocessasuser advapi32.dll
createprocesswithlogon advapi32.dll
createprocesswithtoken advapi32.dll
regopen advapi32.dll
regcreate advapi32.dll
regquery advapi32.dll
regset advapi32.dll
regdelete advapi32.dll
regenum advapi32.dll
regclose advapi32.dll
openscmanager advapi32.dll
openservice advapi32.dll
createservice advapi32.dll
deleteservice advapi32.dll
startservice advapi32.dll
controlservice advapi32.dll
queryservicestatus advapi32.dll
enumservices advapi32.dll
cryptacquire advapi32.dll
cryptrelease advapi32.dll
cryptcreate advapi32.dll
cryptdecrypt advapi32.dll
cryptencrypt advapi32.dll
cryptgenkey advapi32.dll
crypthash advapi32.dll
geteffectiverights advapi32.dll
seteffectiverights advapi32.dll
getacl advapi32.dll
setacl advapi32.dll
getsecurityinfo advapi32.dll
setsecurityinfo advapi32.dll
findwindow user32.dll
findwindowex user32.dll
getwindowtext user32.dll
setwindowtext user32.dll
showwindow user32.dll
createwindow user32.dll
destroywindow user32.dll
getwindowrect user32.dll
setwindowpos user32.dll
enumwindows user32.dll
enumchildwindows user32.dll
sendmessage user32.dll
postmessage user32.dll
getmessage user32.dll
peekmessage user32.dll
dispatchmessage user32.dll
messagebox user32.dll
setwindowshook user32.dll
unhookwindowshook user32.dll
callnexthook user32.dll
getkeyboardstate user32.dll
setkeyboardstate user32.dll
getcursorpos user32.dll
setcursorpos user32.dll
mouse_event user32.dll
keybd_event user32.dll
getdc user32.dll
releasedc user32.dll
getdesktopwindow user32.dll
getforegroundwindow user32.dll
setforegroundwindow user32.dll
textout gdi32.dll
bitblt gdi32.dll
stretchblt gdi32.dll
drawtext gdi32.dll
getstockobject gdi32.dll
deletedc gdi32.dll
createdc gdi32.dll
createcompatibledc gdi32.dll
createbrush gdi32.dll
createpen gdi32.dll
createfont gdi32.dll
selectobject gdi32.dll
deleteobject gdi32.dll
enumprocesses psapi.dll
enumprocessmodules psapi.dll
getprocessimagefilename psapi.dll
getprocessmemoryinfo psapi.dll
getperformanceinfo psapi.dll
wsastartup ws2_32.dll
wsacleanup ws2_32.dll
socket ws2_32.dll
bind ws2_32.dll
listen ws2_32.dll
accept ws2_32.dll
connect ws2_32.dll
send ws2_32.dll
recv ws2_32.dll
closesocket ws2_32.dll
gethostbyname ws2_32.dll
inet_addr ws2_32.dll
internetopen wininet.dll
internetopena wininet.dll
internetopenw wininet.dll
internetconnect wininet.dll
internetconnecta wininet.dll
internetconnectw wininet.dll
httpopenrequest wininet.dll
httpopenrequesta wininet.dll
httpopenrequestw wininet.dll
httpsendrequest wininet.dll
httpsendrequesta wininet.dll
httpqueryinfo wininet.dll
httpqueryinfoa wininet.dll
httpqueryinfow wininet.dll
internetreadfile wininet.dll
internetwritefile wininet.dll
internetclosehandle wininet.dll
internetfindnextfile wininet.dll
internetopenurlw wininet.dll
internetopenurla wininet.dll
internetsetstatuscallback wininet.dll
internetsetoption wininet.dll
internetsetoptiona wininet.dll
internetsetoptionw wininet.dll
internetqueryoption wininet.dll
internetquerydataavailable wininet.dll
urldownloadtofile urlmon.dll
urldownloadtofilew urlmon.dll
urldownloadtofilea urlmon.dll
urldownloadtocache urlmon.dll
winhttpopen winhttp.dll
winhttpopenrequest winhttp.dll
winhttpconnect winhttp.dll
winhttpsendrequest winhttp.dll
winhttpreceiveresponse winhttp.dll
winhttpreaddata winhttp.dll
winhttpclosehandle winhttp.dll
createtoolhelp32snapshot kernel32.dll
process32first kernel32.dll
process32next kernel32.dll
thread32first kernel32.dll
thread32next kernel32.dll
module32first kernel32.dll
module32next kernel32.dll
ftpputfile wininet.dll
ftpputfilea wininet.dll
ftpputfilew wininet.dll
ftpgetfile wininet.dll
ftpgetfilea wininet.dll
ftpgetfilew wininet.dll
ftpopenfile wininet.dll
ntunmapviewofsection ntdll.dll
shellexecute shell32.dll
shgetfolder shell32.dll
shgetspecialfolder shell32.dll
shbrowseforfolder shell32.dll
dragacceptfiles shell32.dll
dragqueryfile shell32.dll
certopen crypt32.dll
certfind crypt32.dll
certclose crypt32.dll
certenum crypt32.dll
toolbar comctl32.dll
createtoolbarex comctl32.dll
createtoolbar comctl32.dll
listview comctl32.dll
treeview comctl32.dll
tabcontrol comctl32.dll
progressbar comctl32.dll
statusbar comctl32.dll
initcommoncontrols comctl32.dll
initcommoncontrolsex comctl32.dll
imagelist_create comctl32.dll
imagelist_destroy comctl32.dll
imagelist_add comctl32.dll
imagelist_remove comctl32.dll
imagelist_replace comctl32.dll
imagelist_geticon comctl32.dll
imagelist_draw comctl32.dll
imagelist_drawex comctl32.dll
createpropertysheet comctl32.dll
propertysheet comctl32.dll
createpropertysheetpage comctl32.dll
destroypropertysheetpage comctl32.dll
malloc msvcrt.dll
calloc msvcrt.dll
realloc msvcrt.dll
free msvcrt.dll
memcpy msvcrt.dll
memset msvcrt.dll
memmove msvcrt.dll
memcmp msvcrt.dll
strlen msvcrt.dll
strcpy msvcrt.dll
strcat msvcrt.dll
strcmp msvcrt.dll
strncmp msvcrt.dll
strstr msvcrt.dll
strchr msvcrt.dll
strrchr msvcrt.dll
sprintf msvcrt.dll
sscanf msvcrt.dll
printf msvcrt.dll
fprintf msvcrt.dll
fopen msvcrt.dll
fclose msvcrt.dll
fread msvcrt.dll
fwrite msvcrt.dll
fseek msvcrt.dll
ftell msvcrt.dll
exit msvcrt.dll
abort msvcrt.dll
atexit msvcrt.dll
getenv msvcrt.dll
system msvcrt.dll
playsound winmm.dll
playsoundw winmm.dll
playsoundar winmm.dll
timegettime winmm.dll
timegetsystemtime winmm.dll
timesetvent winmm.dll
timekillvent winmm.dll
timebeginperiod winmm.dll
timeendperiod winmm.dll
waveoutopen winmm.dll
waveoutclose winmm.dll
waveoutwrite winmm.dll
waveoutpause winmm.dll
waveoutrestart winmm.dll
waveoutreset winmm.dll
waveoutgetvolume winmm.dll
waveoutsetvolume winmm.dll
waveinopen winmm.dll
waveinclose winmm.dll
waveinstart winmm.dll
waveinstop winmm.dll
waveinreset winmm.dll
mciexecute winmm.dll
mcisendcommand winmm.dll
mcisendstring winmm.dll
mcisendstringa winmm.dll
mcisendstringw winmm.dll
setupdigetdeviceregistrypropertya setupapi.dll
setupdigetdeviceregistrypropertyw setupapi.dll
setupdienumdeviceinterfaces setupapi.dll
setupdigetdeviceinterfacedetaila setupapi.dll
setupdigetdeviceinterfacedetailw setupapi.dll
setupdicreatedeviceinfolist setupapi.dll
setupdidestroydeviceinfolist setupapi.dll
setupdienumdeviceinfo setupapi.dll
setupdigetclassdevsa setupapi.dll
setupdigetclassdevsw setupapi.dll
setupdigetclassdevs setupapi.dll
setupdiopendevregkey setupapi.dll
setupdigetdeviceinstallparamsa setupapi.dll
setupdigetdeviceinstallparamsw setupapi.dll
setupdisetdeviceinstallparamsa setupapi.dll
setupdisetdeviceinstallparamsw setupapi.dll
mapandload imagehlp.dll
unmapandload imagehlp.dll
checkapplinst imagehlp.dll
gettimestampforloadedlibrary imagehlp.dll
imageload imagehlp.dll
imageunload imagehlp.dll
imagegetdigest imagehlp.dll
bindimage imagehlp.dll
bindimageex imagehlp.dll
rebaseimage imagehlp.dll
getfileversioinfo version.dll
getfileversioninfoa version.dll
getfileversioninfow version.dll
getfileversioninfosize version.dll
getfileversioninfosizea version.dll
getfileversioninfosizew version.dll
verqueryvalue version.dll
verqueryvaluea version.dll
verqueryvaluew version.dll
verlanguagename version.dll
verlanguagenamea version.dll
verlanguagenamew version.dll
ntcreatefile ntdll.dll
ntcreateprocess ntdll.dll
ntqueryinformationprocess ntdll.dll
ntqueryinformationthread ntdll.dll
ntopenprocess ntdll.dll
ntopenthread ntdll.dll
ntterminateprocess ntdll.dll
ntterminatethread ntdll.dll
ntclose ntdll.dll
ntreadfile ntdll.dll
ntwritefile ntdll.dll
ntdeviceiocontrolfile ntdll.dll
"""

# Pattern, headers.  Patterns match the lower-case name from its start.
HEADER_PATTERNS = r"""
^nt.* winternl ntddk wdm ntifs
^zw.* winternl ntddk wdm ntifs
^rtl.* ntddk wdm ntifs
^ke.* ntddk wdm
^mm.* ntddk wdm
^text.* wingdi
.*blt.* wingdi
^draw.* wingdi
^paint.* wingdi
get.*dc.* wingdi
create.*dc.* wingdi
select.* wingdi
get.*object.*gdi wingdi
^createfilew$ fileapi
^createfilea$ fileapi
^createfile2$ fileapi
^readfile$ fileapi
^writefile$ fileapi
^deletefile$ fileapi
^copyfile$ fileapi
^movefile$ fileapi
^findfirstfile$ fileapi
^findnextfile$ fileapi
^findclose$ fileapi
.*file.* fileapi
^create.*file fileapi
^create.*process processthreadsapi
delete.* wingdi fileapi
copy.* fileapi
move.* fileapi
read.*file fileapi ioapiset
write.*file fileapi ioapiset
get.*drives.* fileapi
get.*logical.*drives fileapi
^getcommandlinea$ processenv
^getcommandlinew$ processenv
get.*command.*line processenv
^virtualalloc$ memoryapi
^virtualallocex$ memoryapi
^virtualfree$ memoryapi
^virtualfreeex$ memoryapi
^virtualprotect$ memoryapi
^virtualprotectex$ memoryapi
^virtualquery$ memoryapi
^virtualqueryex$ memoryapi
virtual.* memoryapi
heap.* heapapi
.*alloc.* memoryapi heapapi
.*memory.* memoryapi
^closehandle$ handleapi
^duplicatehandle$ handleapi
^compareobjecthandles$ handleapi
^gethandleinformation$ handleapi
^sethandleinformation$ handleapi
.*handle.* handleapi
^queryperformancecounter$ profileapi
^queryperformancefrequency$ profileapi
^gettickcount$ sysinfoapi
^gettickcount64$ sysinfoapi
query.*performance.* profileapi
get.*tick.* sysinfoapi
^globalalloc$ winbase
^globalfree$ winbase
^globallock$ winbase
^globalunlock$ winbase
^globalrealloc$ winbase
global.* winbase
^initializeslisthead$ interlockedapi
^interlockedpushslistentry$ interlockedapi
^interlockedpopslistentry$ interlockedapi
^interlockedflushslist$ interlockedapi
^querydepthslist$ interlockedapi
.*slist.* interlockedapi
^setunhandledexceptionfilter$ errhandlingapi
^unhandledexceptionfilter$ errhandlingapi
^addvectoredexceptionhandler$ errhandlingapi
^removevectoredexceptionhandler$ errhandlingapi
.*exception.* errhandlingapi
^getusernameexw$ secext
^getusernameexa$ secext
^getusernamew$ advapi32
^getusernamea$ advapi32
get.*user.*name.* secext advapi32
^coinitialize$ objbase
^coinitializeex$ objbase
^couninitialize$ objbase
^cocreateinstance$ objbase
^cogetclassobject$ objbase
^coclassfactory$ objbase
^coregisterclassobject$ objbase
^corevokeclassobject$ objbase
^cotaskmemalloc$ objbase
^cotaskmemfree$ objbase
co.* objbase combaseapi
^shellexecutew$ shellapi
^shellexecutea$ shellapi
^shellexecuteexw$ shellapi
^shellexecuteexa$ shellapi
^shgetfolderpath$ shlobj_core
^shgetspecialfolderlocation$ shlobj_core
shell.* shellapi
sh.* shellapi
^createprocessw$ processthreadsapi
^createprocessa$ processthreadsapi
^openprocess$ processthreadsapi
^terminateprocess$ processthreadsapi
^createthread$ processthreadsapi
^createremotethread$ processthreadsapi
^openthread$ processthreadsapi
^suspendthread$ processthreadsapi
^resumethread$ processthreadsapi
^terminatethread$ processthreadsapi
.*process.* processthreadsapi
.*thread.* processthreadsapi
terminate.* processthreadsapi
suspend.* processthreadsapi
resume.* processthreadsapi
^regopenkeyexw$ winreg
^regopenkeyexa$ winreg
^regopenkeyex$ winreg
^regopenkeyw$ winreg
^regopenkeya$ winreg
^regopenkey$ winreg
^regcreatekeyexw$ winreg
^regcreatekeyexa$ winreg
^regcreatekeyex$ winreg
^regclosekey$ winreg
reg.* winreg
.*key.* winreg
.*service.* winsvc
^internetopena$ wininet
^internetopenw$ wininet
^internetopen$ wininet
^internetconnecta$ wininet
^internetconnectw$ wininet
^internetconnect$ wininet
^internetreadfile$ wininet
^socket$ winsock2
^wsastartup$ winsock2
^wsacleanup$ winsock2
.*socket.* winsock2
ws.* winsock2
internet.* wininet
net.* lmaccess lmserver
cert.* wincrypt
crypt.* wincrypt bcrypt
.*security.* securitybaseapi
^isdebuggerpresent$ debugapi
.*debug.* debugapi
^getapplicationusermodelidfromtoken$ appmodel
^getcurrentapplicationusermodelid$ appmodel
^getapplicationusermodelid$ appmodel
.*applicationusermodelid.* appmodel
.*appmodel.* appmodel
.*acl.* aclapi
.*effective.* aclapi
.*trustee.* aclapi
^shellexecute$ shellapi
^shellexecuteex$ shellapi
.*console.* consoleapi
^loadlibrarya$ libloaderapi
^loadlibraryw$ libloaderapi
^loadlibrary$ libloaderapi
^freelibrary$ libloaderapi
^getprocaddress$ libloaderapi
^getmodulehandle$ libloaderapi
^getmodulehandlea$ libloaderapi
^getmodulehandlew$ libloaderapi
load.* libloaderapi
get.*module.* libloaderapi
.*library.* libloaderapi
.*toolbar.* commctrl
.*listview.* commctrl
.*treeview.* commctrl
.*tab.* commctrl
.*button.* commctrl
.*edit.* commctrl
.*combo.* commctrl
create.*window.* winuser
^getstockobject$ wingdi
^deletedc$ wingdi
^createdc$ wingdi
^createcompatibledc$ wingdi
^selectobject$ wingdi
^deleteobject$ wingdi
^bitblt$ wingdi
^stretchblt$ wingdi
^textout$ wingdi
^drawtext$ wingdi
.*stock.* wingdi
.*dc.* wingdi
.*brush.* wingdi
.*font.* wingdi
^enumprocesses$ psapi
^createtoolhelp32snapshot$ tlhelp32
^urldownloadtofile$ urlmon
^urldownloadtofilea$ urlmon
^urldownloadtofilew$ urlmon
^winhttpopenrequest$ winhttp
^winhttpopen$ winhttp
^winhttpconnect$ winhttp
^ftpputfile$ wininet
^ftpputfilea$ wininet
^ftpputfilew$ wininet
^(nt|zw)createfile$ wdm ntifs winternl
^(nt|zw)openfile$ wdm ntifs winternl
^(nt|zw)readfile$ wdm ntifs winternl
^(nt|zw)writefile$ wdm ntifs winternl
^(nt|zw)deletefile$ wdm ntifs winternl
^(nt|zw)queryinformationfile$ wdm ntifs winternl
^(nt|zw)setinformationfile$ wdm ntifs winternl
^(nt|zw)queryattributesfile$ wdm ntifs winternl
^(nt|zw)queryfullattributesfile$ wdm ntifs winternl
^(nt|zw)queryvolumeinformationfile$ wdm ntifs winternl
^(nt|zw)setvolumeinformationfile$ wdm ntifs winternl
^(nt|zw)flushinstructioncache$ wdm winternl
^(nt|zw)lockfile$ wdm ntifs winternl
^(nt|zw)unlockfile$ wdm ntifs winternl
^(nt|zw)allocatevirtualmemory$ wdm winternl
^(nt|zw)freevirtualmemory$ wdm winternl
^(nt|zw)protectvirtualmemory$ wdm winternl
^(nt|zw)queryvirtualmemory$ wdm winternl
^(nt|zw)readvirtualmemory$ wdm winternl
^(nt|zw)writevirtualmemory$ wdm winternl
^(nt|zw)mapviewofsection$ wdm winternl
^(nt|zw)unmapviewofsection$ wdm winternl
^(nt|zw)createsection$ wdm winternl
^(nt|zw)opensection$ wdm winternl
^(nt|zw)extendsection$ wdm winternl
^(nt|zw)querysection$ wdm winternl
^(nt|zw)flushmappedfiles$ wdm winternl
^(nt|zw)createprocess$ wdm winternl
^(nt|zw)createprocessex$ wdm winternl
^(nt|zw)openprocess$ wdm winternl
^(nt|zw)terminateprocess$ wdm winternl
^(nt|zw)suspendprocess$ wdm winternl
^(nt|zw)resumeprocess$ wdm winternl
^(nt|zw)queryinformationprocess$ wdm winternl
^(nt|zw)setinformationprocess$ wdm winternl
^(nt|zw)createthread$ wdm winternl
^(nt|zw)createthreadex$ wdm winternl
^(nt|zw)openthread$ wdm winternl
^(nt|zw)terminatethread$ wdm winternl
^(nt|zw)suspendthread$ wdm winternl
^(nt|zw)resumethread$ wdm winternl
^(nt|zw)alertthread$ wdm winternl
^(nt|zw)alertresumethread$ wdm winternl
^(nt|zw)getcontextthread$ wdm winternl
^(nt|zw)setcontextthread$ wdm winternl
^(nt|zw)queryinformationthread$ wdm winternl
^(nt|zw)setinformationthread$ wdm winternl
^(nt|zw)queueapcthread$ wdm winternl
^(nt|zw)testAlert$ wdm winternl
^(nt|zw)createevent$ wdm winternl
^(nt|zw)openevent$ wdm winternl
^(nt|zw)setevent$ wdm winternl
^(nt|zw)resetevent$ wdm winternl
^(nt|zw)pulseevent$ wdm winternl
^(nt|zw)queryevent$ wdm winternl
^(nt|zw)createmutant$ wdm winternl
^(nt|zw)openmutant$ wdm winternl
^(nt|zw)releasemutant$ wdm winternl
^(nt|zw)querymutant$ wdm winternl
^(nt|zw)createsemaphore$ wdm winternl
^(nt|zw)opensemaphore$ wdm winternl
^(nt|zw)releasesemaphore$ wdm winternl
^(nt|zw)querysemaphore$ wdm winternl
^(nt|zw)createtimer$ wdm winternl
^(nt|zw)opentimer$ wdm winternl
^(nt|zw)settimer$ wdm winternl
^(nt|zw)canceltimer$ wdm winternl
^(nt|zw)querytimer$ wdm winternl
^(nt|zw)createjobobject$ wdm winternl
^(nt|zw)openjobobject$ wdm winternl
^(nt|zw)assignprocesstojobobject$ wdm winternl
^(nt|zw)terminatejobobject$ wdm winternl
^(nt|zw)queryinformationjobobject$ wdm winternl
^(nt|zw)setinformationjobobject$ wdm winternl
^(nt|zw)createkey$ wdm winternl
^(nt|zw)openkey$ wdm winternl
^(nt|zw)openkeytransacted$ wdm winternl
^(nt|zw)deletekey$ wdm winternl
^(nt|zw)deletevaluekey$ wdm winternl
^(nt|zw)enumeratekey$ wdm winternl
^(nt|zw)enumeratevaluekey$ wdm winternl
^(nt|zw)flushkey$ wdm winternl
^(nt|zw)loadkey$ wdm winternl
^(nt|zw)loadkey2$ wdm winternl
^(nt|zw)loadkeyex$ wdm winternl
^(nt|zw)notifychangekey$ wdm winternl
^(nt|zw)notifychangemultiplekeys$ wdm winternl
^(nt|zw)querykey$ wdm winternl
^(nt|zw)queryvaluekey$ wdm winternl
^(nt|zw)querymultiplevaluekey$ wdm winternl
^(nt|zw)replacekey$ wdm winternl
^(nt|zw)restorekey$ wdm winternl
^(nt|zw)savekey$ wdm winternl
^(nt|zw)savekeyex$ wdm winternl
^(nt|zw)savemergedkeys$ wdm winternl
^(nt|zw)setvaluekey$ wdm winternl
^(nt|zw)unloadkey$ wdm winternl
^(nt|zw)unloadkey2$ wdm winternl
^(nt|zw)unloadkeyex$ wdm winternl
^(nt|zw)accesscheck$ wdm winternl
^(nt|zw)accesscheckandauditalarm$ wdm winternl
^(nt|zw)accesscheckbytype$ wdm winternl
^(nt|zw)accesscheckbytypeandauditalarm$ wdm winternl
^(nt|zw)adjustgroupstoken$ wdm winternl
^(nt|zw)adjustprivilegestoken$ wdm winternl
^(nt|zw)compareTokens$ wdm winternl
^(nt|zw)createtoken$ wdm winternl
^(nt|zw)duplicatetoken$ wdm winternl
^(nt|zw)filtertoken$ wdm winternl
^(nt|zw)impersonateclientofport$ wdm winternl
^(nt|zw)openprocesstoken$ wdm winternl
^(nt|zw)openprocesstokenex$ wdm winternl
^(nt|zw)openthreadtoken$ wdm winternl
^(nt|zw)openthreadtokenex$ wdm winternl
^(nt|zw)privilegecheck$ wdm winternl
^(nt|zw)queryinformationtoken$ wdm winternl
^(nt|zw)setinformationtoken$ wdm winternl
^(nt|zw)setthreadtoken$ wdm winternl
^(nt|zw)querysysteminformation$ wdm winternl
^(nt|zw)setsysteminformation$ wdm winternl
^(nt|zw)querydefaultlocale$ wdm winternl
^(nt|zw)setdefaultlocale$ wdm winternl
^(nt|zw)querydefaultuilanguage$ wdm winternl
^(nt|zw)setdefaultuilanguage$ wdm winternl
^(nt|zw)queryinstalluilanguage$ wdm winternl
^(nt|zw)querysystemtime$ wdm winternl
^(nt|zw)setsystemtime$ wdm winternl
^(nt|zw)querytimerresolution$ wdm winternl
^(nt|zw)settimerresolution$ wdm winternl
^(nt|zw)delayexecution$ wdm winternl
^(nt|zw)yieldexecution$ wdm winternl
^(nt|zw)close$ wdm winternl
^(nt|zw)duplicateobject$ wdm winternl
^(nt|zw)queryobject$ wdm winternl
^(nt|zw)setinformationobject$ wdm winternl
^(nt|zw)queryinformationobject$ wdm winternl
^(nt|zw)querysecurityobject$ wdm winternl
^(nt|zw)setsecurityobject$ wdm winternl
^(nt|zw)maketemporaryobject$ wdm winternl
^(nt|zw)makepermanentobject$ wdm winternl
^(nt|zw)signalAnDwaitforsingleobject$ wdm winternl
^(nt|zw)waitforsingleobject$ wdm winternl
^(nt|zw)waitformultipleobjects$ wdm winternl
^(nt|zw)waitformultipleobjects32$ wdm winternl
^rtlinitansistring$ winternl ntddk
^rtlinitunicodestring$ winternl ntddk
^rtlinitString$ winternl ntddk
^rtlfreeAnsistring$ winternl ntddk
^rtlfreuUnicodestring$ winternl ntddk
^rtlfreestring$ winternl ntddk
^rtlcopyansistring$ winternl ntddk
^rtlcopyunicodestring$ winternl ntddk
^rtlcopystring$ winternl ntddk
^rtlAnsistring^Tounicodestring$ winternl ntddk
^rtlunicodestringa^Toansistring$ winternl ntddk
^rtlunicodestring^Tointeger$ winternl ntddk
^rtlinteger^Tounicodestring$ winternl ntddk
^rtlcompareAnsistring$ winternl ntddk
^rtlcompareunicodestring$ winternl ntddk
^rtlequAnsistring$ winternl ntddk
^rtleunicodestring$ winternl ntddk
^rtlPrefixAnsistring$ winternl ntddk
^rtlprefixunicodestring$ winternl ntddk
^rtlupperAnsistring$ winternl ntddk
^rtlupperunicodestring$ winternl ntddk
^rtldowncaseunicestring$ winternl ntddk
^rtlAppendansistring^Tostring$ winternl ntddk
^rtllookupfunctionentry$ winnt
^rtlvirtualunwind$ winnt
^rtladdfunctiontable$ winnt
^rtldeletefunctiontable$ winnt
^rtlinstallfunctiontablecallback$ winnt
^rtlrestorecontext$ winnt
^rtlunwind$ winnt
^rtlunwind2$ winnt
^rtlunwindex$ winnt
^rtlzeromemory$ wdm
^rtlmovememory$ winternl ntddk
^rtlcopymemory$ wdm
^rtlcomparememory$ winternl ntddk
^rtlfillmemory$ winternl ntddk
^rtlappensui$ winternl ntddk
^rtlallocateheap$ winternl ntddk
^rtlfreeheap$ winternl ntddk
^rtlcreateheap$ winternl ntddk
^rtldestroyheap$ winternl ntddk
^rtlsizeheap$ winternl ntddk
^rtlvalidateheap$ winternl ntddk
^rtlreAllocateheap$ winternl ntddk
^rtlcompactheap$ winternl ntddk
^rtllockheap$ winternl ntddk
^rtlunlockheap$ winternl ntddk
^rtlcopybytes$ winternl ntddk
^rtlsecurezeromemory$ winternl ntddk
^rtlinitializecriticalsection$ winternl ntddk
^rtldeletecriticalsection$ winternl ntddk
^rtlentercriticalsection$ winternl ntddk
^rtlleavecriticalsection$ winternl ntddk
^rtltrycriticalsection$ winternl ntddk
^rtlinitializecriticalsectionAndspincount$ winternl ntddk
^rtlsetcriticalsectionspincount$ winternl ntddk
^rtlcreateuserthead$ winternl ntddk
^rtlexitusertehead$ winternl ntddk
^rtlremoteusertread$ winternl ntddk
^rtlisthread^Terminating$ winternl ntddk
^rtlgetcurrentdirectory$ winternl ntddk
^rtlsetcurrentdirectory$ winternl ntddk
^rtlgetfullpathname$ winternl ntddk
^rtldospathnametonpath^Name$ winternl ntddk
^rtldeterminedospathnameype$ winternl ntddk
^rtlisDosDevicename$ winternl ntddk
^rtlgetlonPpathname$ winternl ntddk
^rtlgetshortpathname$ winternl ntddk
^rtlqueryen^Tvironmentvariable$ winternl ntddk
^rtlsetenv$ winternl ntddk
^rtlsetenvironmentvariable$ winternl ntddk
^rtlexpandenvironmentstings$ winternl ntddk
^rtlcreateenvironment$ winternl ntddk
^rtlDestroyenvironment$ winternl ntddk
^rtlsystemtimetolocaltime$ winternl ntddk
^rtllocaltimetosystemtime$ winternl ntddk
^rtltimetotime^Fields$ winternl ntddk
^rtltimeieldstode$ winternl ntddk
^rtltimetoseconds$ winternl ntddk
^rtlsecondstoe$ winternl ntddk
^rtlquerytime^Zone$ winternl ntddk
^rtlrandom$ winternl ntddk
^rtlrandomex$ winternl ntddk
^rtluniform$ winternl ntddk
^ldrloaddll$ winternl ntddk
^ldrunloaddll$ winternl ntddk
^ldrgetprocedureaddress$ winternl ntddk
^ldrgetdllhandle$ winternl ntddk
^ldrgetdllhandleex$ winternl ntddk
^ldrqueriyimagefileexecutionoptions$ winternl ntddk
^ldrfindentryforaddress$ winternl ntddk
^ldrfindresource$ winternl ntddk
^ldrfindresourceex$ winternl ntddk
^ldraccessresource$ winternl ntddk
^ldrfindresourcediretory$ winternl ntddk
^ldrenumeratesources$ winternl ntddk
^ldrenumerareresourcenames$ winternl ntddk
^ldrenumerateresourcelanguages$ winternl ntddk
^ldrprocessrAlocationblock$ winternl ntddk
^ldrverifyourrimage^Inmemor$ winternl ntddk
^ldrlockloaderlock$ winternl ntddk
^ldrunlockloaderlock$ winternl ntddk
^ldrreelocation^Block$ winternl ntddk
.*toolhelp.* tlhelp32
.*snapshot.* tlhelp32
^process32first$ tlhelp32
^process32next$ tlhelp32
^thread32first$ tlhelp32
^thread32next$ tlhelp32
^module32first$ tlhelp32
^module32next$ tlhelp32
.*processes$ psapi
enum.* psapi winreg commctrl
url.* urlmon
.*download.* urlmon
winhttp.* winhttp
http.* winhttp wininet
ftp.* wininet
"""
